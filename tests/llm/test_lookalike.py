import math
import random
import unicodedata
from itertools import product

import pytest

from strandline.llm import lookalike as k

RUSSIAN = "Москва большой город и хорошая погода сегодня вечером после работы"
ENGLISH = "the bank and its cash desk once a year after the report of a cat on the mat"


def skeleton(text):
    """Letter by letter, without the tables of composed letters."""
    for _ in range(2):
        out = []
        for c in unicodedata.normalize("NFD", text):
            kind = unicodedata.category(c)
            out.append("" if kind == "Cf" else " " if kind == "Zs" else "-" if c in k.HYPHENS else k.LATIN_OF.get(c, c))
        text = unicodedata.normalize("NFKC", "".join(out))
    return text


def test_same_form_exactly_for_the_same_look():
    r = random.Random(6)
    pieces = list("cсоoοaажДﬁＷW-1π\nαρꭺꓮⲀAϲ‐‑−‒") + ["é", "é", "fi", "​", "­", " ", " ", " ", "й", "й", "ї", "ї", "ï"]
    former = k.Former(k.pair_counts([RUSSIAN, ENGLISH]))
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(1, 7))) for _ in range(5000)]
    forms = dict(zip(texts, former.forms(texts)))
    seen = {}
    for x, f in forms.items():
        assert seen.setdefault(skeleton(x), f) == f
    assert len(set(forms.values())) == len(seen)


def test_words_stay_in_or_return_to_their_script():
    former = k.Former(k.pair_counts([RUSSIAN, ENGLISH]))
    assert former.forms(["Мoсквa", "Москва", "bаnk аnd саsh", "сat"]) == ["Москва", "Москва", "bank and cash", "cat"]
    assert former.form("Ｆｕｌｌ wi​dth") == "Full width" and former.form("café") == "café"


def test_the_path_depends_on_the_corpus():
    """A word that both scripts can draw is read as the corpus writes it, whichever letters it came in."""
    few, many = k.pair_counts([ENGLISH, "cop cop cop cop", "сор"]), k.pair_counts([ENGLISH, "cop cop cop cop"] + ["сор сор сор"] * 50)
    assert set(k.Former(few).forms(["сор", "cop"])) == {"cop"} and set(k.Former(many).forms(["сор", "cop"])) == {"сор"}


def test_best_path_of_all():
    """Viterbi's path has the best score of all paths through the lattice."""
    former = k.Former(k.pair_counts([RUSSIAN, ENGLISH, "ο ρ ν α Α Β"]))
    r = random.Random(3)
    for _ in range(300):
        token = "".join(r.choice("acopxTBжйvdu") for _ in range(r.randrange(1, 5)))
        numbers = [former._number(c) for c in token]

        def score(path):
            total = former.score[path[0], 0, numbers[0]]
            for i in range(1, len(path)):
                total += former.score[path[i], numbers[i - 1], numbers[i]] if path[i] == path[i - 1] else k.UNSEEN - k.SWITCH
            return total

        best = max(score(p) for p in product(*[k.choices(c) for c in token]))
        assert math.isclose(score(former.paths([token])[0]), best)


def test_visible_differences_stay():
    former = k.Former()
    texts = ["Cafe", "cafe", "café", "cafe1", "cafel", "cafe.", "ca-fe", "ca—fe", "ca\nfe", "ca fe", "c\tafe", "cafı", "cafi"]
    assert len(set(former.forms(texts))) == len(texts)


ROWS = [(1, "a b"), (2, "a b"), (3, "a b"), (4, "A b"), (5, None), (6, ""), (7, "a b"), (8, "​"), (9, "​​"), (None, "a b"), (10, "x" * 50_000 + "­"), (11, "x" * 50_000)]


def frame(spark, rows):
    return spark.createDataFrame([(*x, "y", 1) for x in rows], "doc_id long, text string, form string, text_id int")


def test_pairs(spark):
    df = frame(spark, ROWS)
    got = sorted(map(tuple, k.alike(df, "doc_id", "text").collect()))
    assert got == [(1, 2), (1, 3), (1, 7), (8, 9), (10, 11)]
    assert k.alike(df.limit(0), "doc_id", "text").count() == 0
    assert {x["doc_id"]: x["form"] for x in k.forms(df, "doc_id", "text").collect()}[1] == "a b"


def test_classes(spark):
    got = sorted(map(tuple, k.classes(frame(spark, ROWS), "doc_id", "text").collect()))
    assert got == [(1, 1, 3), (2, 1, 1), (3, 1, 1), (7, 1, 1), (8, 8, 1), (9, 8, 1), (10, 10, 1), (11, 10, 1)]


@pytest.mark.parametrize("wrong", [lambda tokens: [[0] * len(t) for t in tokens], None])
def test_rows_come_from_the_path(spark, monkeypatch, wrong):
    """What the search returns is what the pairs are found by."""
    rows = [(1, "соp"), (2, "сор"), (3, "caр"), (4, "cap"), (5, "cat")]
    if wrong is None:
        monkeypatch.setattr(k.Former, "learn", lambda self, tokens: self.other.update(dict.fromkeys(tokens, "x")))
        want = [(a, b) for a in range(1, 6) for b in range(a + 1, 6)]
    else:
        want = [(1, 2), (3, 4)]
    former = k.Former(k.pair_counts([t for _, t in rows]))
    forms = former.forms([t for _, t in rows])
    assert [(a + 1, b + 1) for a in range(5) for b in range(a + 1, 5) if forms[a] == forms[b]] == want
