"""Stems of words from the published sample of the rules."""

from pyspark.sql import functions as F

from listingflow.functions.stem import stem

# Word and stem.
SAMPLE = """che che|checa chec|checar chec|checo chec|checoslovaquia checoslovaqui|chefs chefs|chelo chel|chemical chemical|chemise chemis|cheque chequ|
chequeo cheque|cheques chequ|chester chest|chetumal chetumal|chetumaleños chetumaleñ|chi chi|chía chi|chiapaneca chiapanec|chiapas chiap|chica chic|
chicago chicag|chicana chican|chicano chican|chicas chic|chicharrones chicharron|chichimecas chichimec|chicles chicl|chico chic|
torá tor|tórax torax|torcer torc|toreado tor|toreados tor|toreándolo tor|torear tor|toreara tor|torearlo tor|toreó tore|torero torer|toreros torer|
torio tori|tormenta torment|tormentas torment|tornado torn|tornados torn|tornar torn|tornen torn|torneo torne|torneos torne|tornillo tornill|
tornillos tornill|torniquete torniquet|torno torn|toro tor|toronto toront|toros tor|torpedearon torped|torpeza torpez|torrado torr|torralba torralb|
torre torr|torrencial torrencial|torrenciales torrencial|torrente torrent|torreón torreon|torres torr"""


def test_published_sample(spark):
    pairs = [tuple(x.split()) for x in SAMPLE.replace("\n", "").split("|")]
    df = spark.createDataFrame([(w,) for w, _ in pairs], "word string")
    got = {r.word: r.stem for r in df.select("word", stem(F.col("word")).alias("stem")).collect()}
    assert got == dict(pairs)


def test_groups_of_word_forms(spark):
    groups = [["concierto", "conciertos"], ["actuación", "actuaciones"], ["cantando", "cantaron", "cantaba"],
              ["publicidad", "publicidades"], ["biología", "biologías"], ["exposición", "exposiciones"], ["teatro", "teatros"]]
    df = spark.createDataFrame([(w,) for g in groups for w in g], "word string")
    got = {r.word: r.stem for r in df.select("word", stem(F.col("word")).alias("stem")).collect()}
    assert all(len({got[w] for w in g}) == 1 for g in groups), got


def test_odd_words(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",), ("y",), ("42",), ("ñ" * 50,), ("日本",)], "word string")
    assert [r.s for r in df.select(stem(F.col("word")).alias("s")).collect()] == [None, "", "a", "y", "42", "ñ" * 50, "日本"]
