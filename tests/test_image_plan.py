"""Each selection stands once in the plan of the image of a page."""

from listingflow.sources import pages


def test_a_selection_stands_once_in_the_plan(spark):
    df = spark.createDataFrame([(1, "x", "<img src=a>")], "page_id long, url string, html string")
    image = pages.extract_image(df)._jdf.queryExecution().analyzed().toString()
    assert image.count("detail-image") == 1 and image.count("main-image") == 1
