"""The similarity kernel against textbook definitions."""

import random

from listingflow.functions import similarity as sim


def dp_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def words(rng, n):
    pool = ["rock", "jazz", "fito", "fitipaldi", "noche", "de", "la", "concierto", "x" * 40, "ñu", "gira"]
    return " ".join(rng.choice(pool) + rng.choice(["", "s", "o"]) for _ in range(n))


def test_lcs_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        a, b = words(rng, rng.randint(0, 5)), words(rng, rng.randint(0, 5))
        assert sim.lcs_length(a, b) == dp_lcs(a, b)


def test_hand_worked_scores():
    assert sim.ratio("", "") == 100.0
    assert sim.ratio("abcd", "abed") == 75.0
    assert sim.token_set_ratio("", "a") == 0.0
    assert sim.token_set_ratio("carles sans", "carles sans por fin me voy") == 100.0
    assert sim.token_set_ratio("b a", "a b b") == 100.0
    # common "fito" (4), rests "y" and "e": 2*4/(4+6) beats 2*5/(6+6).
    assert round(sim.token_set_ratio("fito y", "fito e"), 4) == round(max(1000 / 12, 800 / 10), 4)
    assert sim.title_score("abcd", "abed") == 75.0


def slow_leaders(titles, threshold, use_ratio):
    leaders, out = [], []
    for t in titles:
        hit = next((x for x in leaders if sim.title_score(t, x, use_ratio) >= threshold), None)
        if hit is None:
            leaders.append(t)
            hit = t
        out.append(hit)
    return out


def test_leaders_equal_scalar_pass():
    rng = random.Random(2)
    for trial in range(30):
        titles = list(dict.fromkeys(words(rng, rng.randint(0, 6)) for _ in range(120)))
        for use_ratio, threshold in ((True, 82), (False, 90), (True, 60)):
            want = slow_leaders(titles, threshold, use_ratio)
            got = sim.follow_leaders(titles, sim.Leaders(threshold, use_ratio))
            assert got == want, (trial, use_ratio, threshold)


def test_answer_does_not_depend_on_the_number_of_leaders():
    rng = random.Random(5)
    pair = ["abba ab cc b cbaa", "cc aa a ab cbaa"]
    assert round(sim.title_score(*pair), 2) == 81.25
    for others in (0, 26, 5000):
        leaders = sim.Leaders(82, True)
        for i in range(others):
            leaders.add(f"unrelated number {i} {'xyz'[i % 3] * (40 + i % 20)}")
        leaders.add(pair[0])
        assert leaders.first(pair[1]) == -1

    def scrambled():
        return " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 6)))

    for use_ratio, threshold in ((True, 82), (False, 70), (True, 70), (False, 90)):
        for _ in range(6000):
            a, b = scrambled(), scrambled()
            if a == b:
                continue
            leaders = sim.Leaders(threshold, use_ratio)
            leaders.add(a)
            assert (leaders.first(b) == 0) == (sim.title_score(b, a, use_ratio) >= threshold), (a, b)


def test_few_titles_follow_the_same_leaders():
    rng = random.Random(5)
    for threshold, use_ratio in ((90, False), (82, True)):
        score = sim.cached_score(use_ratio)
        for _ in range(300):
            titles = list(dict.fromkeys(" ".join(rng.choice(["rock", "rockk", "jazz", "luna", "lunas"]) for _ in range(rng.randint(0, 4))) for _ in range(9)))
            assert sim.follow_few(titles, score, threshold) == sim.follow_leaders(titles, sim.Leaders(threshold, use_ratio))
