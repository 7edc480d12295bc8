"""One consistent form for texts that look the same but are made of different characters."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.lineage import cut
from strandline.operators.skew import join_split

# Letters of other scripts, each below the Latin letter that it is drawn like.
LATIN = {
    "Cyrillic": ("aceopxyijshdqwlABCEHIJKMOPSTXYdQWGvVI", "асеорхуіјѕһԁԛԝӏАВСЕНІЈКМОРЅТХҮԀԚԜԌѵѴӀ"),
    "Greek": ("aopuvcjABEFHIJKMNOPTXYZC", "αορυνϲϳΑΒΕϜΗΙͿΚΜΝΟΡΤΧΥΖϹ"),
    "Armenian": ("onuhgqwfOSU", "օոսհցզաքՕՏՍ"),
    "Cherokee": ("ABCDEGHIJKLMPRSTVWYZhi", "ᎪᏴᏟᎠᎬᏀᎻᏆᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᎩᏃᏂᎥ"),
    "Coptic": ("ABCEHIKMNOPTXYopc", "ⲀⲂⲤⲈⲎⲒⲔⲘⲚⲞⲢⲦⲬⲨⲟⲣⲥ"),
    "Lisu": ("ABCDEFGHIJKLMNOPRSTUVWXYZ", "ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ"),
}
# Hyphens and minus signs drawn like the plain hyphen, and ignorable characters that are no format characters.
HYPHENS = "‐‑‒−˗⁃"
IGNORED = "͏ᅟᅠ឴឵᠋᠌᠍"

SCRIPTS = ("Latin", *LATIN)
OTHER = len(SCRIPTS)
#: Log scores of a change of script within a token, and of a pair of letters that the corpus has not shown.
SWITCH, UNSEEN = 12.0, -9.0
#: Tokens whose path a task keeps.
KEPT = 500_000


@lru_cache(maxsize=None)
def script_of(letter: str) -> int:
    """Number of the letter's script in SCRIPTS; OTHER for any other."""
    first = unicodedata.name(letter, "").split(" ")[0].capitalize()
    return SCRIPTS.index(first) if first in SCRIPTS else OTHER


def _tables() -> tuple[dict[str, str], dict[str, dict[int, str]]]:
    """The Latin letter of each look-alike, and by Latin letter the one drawn like it in each script."""
    latin, drawn = {}, {}
    for number, script in enumerate(LATIN, 1):
        for a, b in zip(*LATIN[script], strict=True):
            latin[b] = a
            drawn.setdefault(a, {0: a}).setdefault(number, b)
    return latin, drawn


LATIN_OF, DRAWN = _tables()


def _replacements() -> dict[str, str]:
    """What each character that needs it becomes: nothing, a plain space or hyphen, the Latin letter, with its accents if it has any."""
    to = {}
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Cf" or c in IGNORED or 0xFE00 <= code <= 0xFE0F or 0xE0000 <= code <= 0xE0FFF:
            to[c] = ""
        elif kind == "Zs" and c != " ":
            to[c] = " "
        elif kind[0] == "L" and code < 0xA500 and (parts := unicodedata.normalize("NFD", c))[0] in LATIN_OF:
            to[c] = unicodedata.normalize("NFC", LATIN_OF[parts[0]] + parts[1:])
    return to | {c: "-" for c in HYPHENS}


def one_of(characters: Iterable[str]) -> str:
    """The ranges of these characters, for a set in a pattern."""
    codes = sorted(map(ord, characters))
    firsts = [c for c, before in zip(codes, [-2, *codes]) if c != before + 1]
    lasts = [c for c, after in zip(codes, [*codes[1:], -2]) if after != c + 1]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(firsts, lasts))


REPLACED = _replacements()
SPECIAL = re.compile(f"[{one_of(REPLACED)}]")
LETTERS = re.compile(r"[^\W\d_]+")


def lattice(text: str) -> str:
    """The text after compatibility normalization and deletion of ignorable characters, each set of letters drawn alike being written as its Latin one.

    Two texts look the same exactly if they have the same lattice.
    """
    if text.isascii():
        return text
    text = SPECIAL.sub(lambda m: REPLACED[m[0]], text)
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFC", SPECIAL.sub(lambda m: REPLACED[m[0]], unicodedata.normalize("NFKC", text)))
    return text


def choices(letter: str) -> dict[int, str]:
    """By script, the letters drawn like this one of a lattice."""
    if letter in DRAWN:
        return DRAWN[letter]
    parts = unicodedata.normalize("NFD", letter)
    if parts[0] in DRAWN:
        return {s: unicodedata.normalize("NFC", x + parts[1:]) for s, x in DRAWN[parts[0]].items()}
    return {script_of(letter): letter}


class Former:
    """Viterbi search of lattices. pairs: how often, by script, a letter follows another (or "" at a token's beginning) in the corpus."""

    def __init__(self, pairs: dict[tuple[int, str, str], int] | None = None):
        pairs = pairs or {}
        totals: Counter = Counter()
        for (script, a, _), n in pairs.items():
            # Which script a token begins with is part of the score, so beginnings are shares of all tokens.
            totals[script if a else None, a] += n
        letters = sorted({REPLACED.get(c, c) for _, _, c in pairs} | set(DRAWN))
        self.number = {c: i for i, c in enumerate((c for c in letters if len(c) == 1), OTHER + 2)}
        size = len(self.number) + OTHER + 2
        # Number 0 is a token's beginning, 1 to OTHER + 1 are letters of each script that the corpus has not shown.
        self.score = np.full((OTHER + 1, size, size), UNSEEN)
        self.allowed = np.full((OTHER + 1, size), -np.inf)
        self.drawn = {c: choices(c) for c in self.number}
        by_drawn = {(s, x): i for c, i in self.number.items() for s, x in self.drawn[c].items()}
        for s in range(OTHER + 1):
            self.allowed[s, s + 1] = 0.0
        for c, i in self.number.items():
            for s in self.drawn[c]:
                self.allowed[s, i] = 0.0
        for (s, a, b), n in pairs.items():
            i, j = by_drawn.get((s, a)) if a else 0, by_drawn.get((s, b))
            if i is not None and j is not None:
                self.score[s, i, j] = np.log(n / totals[s if a else None, a])
        self.latin: set[str] = set()
        self.other: dict[str, str] = {}

    def _number(self, letter: str) -> int:
        i = self.number.get(letter)
        return i if i is not None else script_of(letter) + 1

    def paths(self, tokens: list[str]) -> list[list[int]]:
        """The script of each letter on the best path of each token: best pairs of letters with the fewest changes of script, of equal ones the first script.

        All tokens take a step at a time, the longest first, so the step's arrays hold the tokens that are long enough.
        """
        order = sorted(range(len(tokens)), key=lambda i: -len(tokens[i]))
        lengths = np.array([len(tokens[i]) for i in order])
        seen: dict[str, int] = {}
        numbers = [[seen[c] if c in seen else seen.setdefault(c, self._number(c)) for c in tokens[i]] for i in order]
        steps, best, last = [], None, None
        for t in range(int(lengths[0]) if len(order) else 0):
            active = int(np.searchsorted(-lengths, -t, side="left"))
            here = np.fromiter((n[t] for n in numbers[:active]), np.int64, active)
            allowed = self.allowed[:, here]
            if t == 0:
                best = self.score[:, 0, here] + allowed
            else:
                best, last = best[:, :active], last[:active]
                top = best.argmax(axis=0)
                change = best[top, np.arange(active)] + UNSEEN - SWITCH
                stay = best + self.score[:, last, here]
                stays = stay >= change
                steps.append(np.where(stays, np.arange(OTHER + 1)[:, None], top).astype(np.int8))
                best = np.where(stays, stay, change) + allowed
            last = here
            # Tokens that end here keep their best script in ends.
            if t == 0:
                ends, at = np.zeros(len(order), np.int8), best.argmax(axis=0)
            else:
                at = best.argmax(axis=0)
            done = lengths[:active] == t + 1
            ends[:active][done] = at[done]
        out: list[list[int]] = [[] for _ in tokens]
        for k, i in enumerate(order):
            s = int(ends[k])
            path = [s]
            for t in range(len(tokens[i]) - 2, -1, -1):
                s = int(steps[t][s, k])
                path.append(s)
            out[i] = path[::-1]
        return out

    def learn(self, tokens: set[str]) -> None:
        """Finds the paths of these tokens of lattices and remembers what they read."""
        if len(self.latin) + len(self.other) > KEPT:
            self.latin, self.other = set(), {}
        new = sorted(tokens - self.latin - self.other.keys())
        for token, path in zip(new, self.paths(new)):
            if any(path):
                self.other[token] = "".join(choices(c).get(s, c) for c, s in zip(token, path))
            else:
                self.latin.add(token)

    def forms(self, texts: list[str]) -> list[str]:
        """The consistent form of each text: every token of letters is read by the best path through its lattice.

        The lattice holds, for each letter, all letters drawn like it, so tokens that look the same have the same lattice and get the same path, and
        no other token has it.
        """
        lattices = [lattice(t) for t in texts]
        tokens = [set(LETTERS.findall(t)) for t in lattices]
        self.learn(set().union(*tokens))
        read = lambda m: self.other.get(m[0], m[0])
        return [t if own.isdisjoint(self.other) else LETTERS.sub(read, t) for t, own in zip(lattices, tokens)]

    def form(self, text: str) -> str:
        return self.forms([text])[0]


@lru_cache(maxsize=1)
def _letter_numbers() -> tuple[np.ndarray, list[str]]:
    """Numbers from 1 of all letters of SCRIPTS by code, 0 for any other character, and the letters by number."""
    letters = [c for c in map(chr, range(0x41, 0x10000)) if unicodedata.category(c)[0] == "L" and script_of(c) != OTHER]
    table = np.zeros(sys.maxunicode + 1, np.int32)
    table[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
    return table, ["", *letters]


def pair_counts(texts: list[str]) -> Counter:
    """How often a letter follows another one of the same script, or begins a run of letters ("" before it), in the normalized texts."""
    table, letters = _letter_numbers()
    text = "\n" + "\n".join(t if t.isascii() else unicodedata.normalize("NFKC", t) for t in texts)
    numbers = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    present = np.flatnonzero(np.bincount(numbers, minlength=1))
    compact = np.zeros(len(letters), np.int64)
    compact[present] = np.arange(len(present))
    c = compact[numbers]
    width = len(present)
    counts = np.bincount(c[:-1] * width + c[1:], minlength=1)
    out: Counter = Counter()
    for pair in np.flatnonzero(counts):
        a, b = letters[present[pair // width]], letters[present[pair % width]]
        if b and (not a or script_of(a) == script_of(b)):
            out[script_of(b), a, b] += int(counts[pair])
    return out


#: Texts that a task's arrays hold at a time.
BATCH = 256


def letter_pairs(df: DataFrame, text: str) -> dict[tuple[int, str, str], int]:
    """Pair counts over all texts; their number is bounded by the alphabets of SCRIPTS."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), BATCH):
                counts.update(pair_counts(texts[at : at + BATCH]))
        s, a, b = zip(*counts) if counts else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(s, pa.int32()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(list(counts.values()), pa.int64())], ["script", "a", "b", "n"]
        )

    some = df.select(F.col(text).alias("t")).where("t <> ''")
    rows = some.mapInArrow(counted, "script int, a string, b string, n long").groupBy("script", "a", "b").agg(F.sum("n").alias("n"))
    return {(r["script"], r["a"], r["b"]): r["n"] for r in rows.collect()}


def forms(df: DataFrame, key: str, text: str, whole: bool = True) -> DataFrame:
    """Rows (key, form, form_id, text_id) of all non-empty texts: the consistent form (only if whole), its 128-bit id and that of the text itself.

    Null and empty texts have no row; texts are never cut; repeated rows come out each; further columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(letter_pairs(df, text))

    def formed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        former, digest = Former(shared.value), xxhash.xxh3_128_digest
        for batch in batches:
            texts = batch.column(1).to_pylist()
            got = [f for at in range(0, len(texts), BATCH) for f in former.forms(texts[at : at + BATCH])]
            ids = [pa.array([digest(t.encode()) for t in ts], pa.binary()) for ts in (got, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got if whole else [None] * len(got), pa.string()), *ids], ["key", "form", "form_id", "text_id"])

    rows = df.where((F.col(text) != "")).select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(formed, f"key {kind}, form string, form_id binary, text_id binary").withColumnRenamed("key", key)
    return out if whole else out.drop("form")


def _mixed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, form_id, text_id) of the forms that two or more different texts have; only these can have a partner."""
    rows = cut(forms(df, key, text, whole=False).where(F.col(key).isNotNull()))
    texts = rows.groupBy("form_id").agg(F.min("text_id").alias("a"), F.max("text_id").alias("b"))
    return cut(rows.join(texts.where("a <> b").select("form_id"), "form_id", "left_semi"))


def classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row (key, class_id, n_links) per record that has one: class_id is the smallest key of its form, n_links counts the records of other characters in it.

    Only forms with two or more different texts are classes. Null keys have no row; a key that is there twice counts once with each of its texts.
    """
    rows = _mixed(df, key, text).distinct()
    own = rows.groupBy("form_id", "text_id").agg(F.count(F.lit(1)).alias("_own"))
    whole = own.groupBy("form_id").agg(F.sum("_own").alias("_all"))
    first = rows.groupBy("form_id").agg(F.min(key).alias("class_id"))
    counts = own.join(whole, "form_id").join(first, "form_id").select("text_id", "class_id", (F.col("_all") - F.col("_own")).alias("n_links"))
    return join_split(rows.select(key, "text_id"), counts, ["text_id"]).select(key, "class_id", "n_links")


def alike(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (key_a < key_b) of records whose texts have equal forms but are not the same characters.

    Only records of forms with two or more different texts are paired, so exact copies alone never meet each other. A form that very many
    records have is split on both sides. Null keys have no pair.
    """
    mixed = _mixed(df, key, text).distinct()
    a = mixed.select("form_id", F.col("text_id").alias("text_a"), F.col(key).alias("a"))
    b = mixed.select("form_id", F.col("text_id").alias("text_b"), F.col(key).alias("b"))
    return join_split(a, b, ["form_id"]).where("a < b and text_a <> text_b").select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b")).distinct()
