import random
import re

from strandline.sources import paf

GOOD = ["r1", "100", "0", "50", "+", "chr1", "1000", "10", "60", "45", "50", "60", "tp:A:P", "de:f:0.01"]


def reason(line):
    """Reads a line a character at a time."""
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i += 1
            out = ""
            while True:
                j = line.find('"', i)
                if j < 0:
                    return "quoting"
                out += line[i:j]
                if line[j + 1 : j + 2] == '"':
                    out += '"'
                    i = j + 2
                    continue
                i = j + 1
                break
            if i < n and line[i] != "\t":
                return "quoting"
        else:
            j = line.find("\t", i)
            j = n if j < 0 else j
            out, i = line[i:j], j
        fields.append(out)
        if i >= n:
            break
        i += 1
    digits = lambda t: t != "" and all(c in "0123456789" for c in t)
    if not 14 <= len(fields) <= 16:
        return "columns"
    if not digits(fields[11]) or int(fields[11]) > 255:
        return "mapq"
    de = [t for t in fields[12:] if t.startswith("de:")]
    if len(de) != 1 or not de[0].startswith("de:f:"):
        return "de_tag"
    if not re.fullmatch(r"[0-9]+(\.[0-9]+)?(e[+-]?[0-9]+)?", de[0][5:]) or float(de[0][5:]) > 1:
        return "de_tag"
    if fields[4] not in ("+", "-") or not fields[0] or not fields[5] or not all(digits(fields[k]) for k in (1, 2, 3, 6, 7, 8, 9, 10)):
        return "other"
    f = [int(fields[k]) if digits(fields[k]) else 0 for k in range(11)]
    return None if f[2] <= f[3] <= f[1] and f[7] <= f[8] <= f[6] else "other"


def judged(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, raw_line string").selectExpr("*", "1 as mapq", "2 as tags", "3 as errors", "'x' as _split")
    got = {x["line_no"]: x["reason"] for x in paf.bad_lines(df).select("line_no", "reason").collect()}
    return [got.get(i) for i in range(len(lines))], df


def with_(k, v):
    return "\t".join(v if i == k else f for i, f in enumerate(GOOD))


def test_each_reason_and_its_order(spark):
    lines = [
        "\t".join(GOOD), with_(0, '"a\tb""c"'), with_(0, 'a"b'), with_(0, '"ab'), with_(0, '"ab"c'), with_(13, '"de:f:0.5'), "", None, "-- 0 rows --",
        "\t".join(GOOD + ["x"] * 3), with_(11, "256"), with_(11, "0255"), with_(11, ""), with_(11, "٣"), with_(11, "60\n"), with_(13, "de:f:1.5"), with_(13, "de:f:.5"),
        with_(13, "de:f:5e-2"), with_(13, "de:i:0"), with_(12, "de:f:0.2"), with_(13, "xx:f:0"), with_(4, "*"), with_(0, ""), with_(1, "10"), with_(2, "-1"), with_(6, "9" * 40),
        with_(0, '""'), with_(0, '"' + '""' * 3000 + '"'), with_(0, "x" * 100_000), with_(13, "de:f:0.1\t") + "", with_(0, '"') + '"',
    ]
    got, _ = judged(spark, lines)
    assert got == [reason(x) if x is not None else "columns" for x in lines]


def test_random_damage(spark):
    r = random.Random(3)
    lines = []
    for _ in range(600):
        s = list("\t".join(GOOD))
        for _ in range(r.randrange(4)):
            k = r.randrange(len(s))
            s[k : k + r.randrange(2)] = r.choice(['"', '""', "\t", "9", "-", "e", ".", 'a"'])
        if r.random() < 0.4:
            s = list('"' + "".join(s).replace("\t", '"\t', 1))
        lines.append("".join(s))
    got, df = judged(spark, lines)
    assert got == [reason(x) for x in lines]
    loaded = paf.load(df)
    assert loaded.count() == sum(x is None for x in got) and dict(loaded.dtypes)["ref_end"] == "bigint"


def test_empty_table(spark):
    got, df = judged(spark, [])
    assert got == [] and paf.load(df).count() == 0
