import base64
import quopri
import random

from strandline.llm import leakage, mail

WORDS = [f"{a}{b}{c}" for a in ("mor", "zel", "fyn", "vax") for b in ("o", "i", "u") for c in ("th", "ss", "qu", "nyx", "bel")]


def message(body, headers="", sep="\n\n"):
    return f"From: a@b.test\nSubject: x\n{headers}".rstrip("\n") + sep + body


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(*x, "x", 1) for x in docs], "doc_id long, text string, term string, item_id int")
    i = spark.createDataFrame([(*x, "x") for x in items], "item_id long, item_text string, doc_id string")
    return sorted(map(tuple, leakage.leaks(d, "doc_id", "text", i, "item_id", "item_text", **more).collect()))


def sentence(r, n):
    return [r.choice(WORDS) for _ in range(n)]


def test_passages_in_every_coat(spark):
    r = random.Random(8)
    item = sentence(r, 30)
    part = item[5:17]
    text = " ".join(part)
    html = "<html><body><p>" + "<br>\n".join(f"<b>{w[:3]}</b>{w[3:]}&nbsp;" for w in part) + "</p></body></html>"
    b64 = base64.encodebytes(f"before {text} after".encode()).decode()
    mixed = "Content-Type: multipart/mixed; boundary=\"bb\""
    docs = [
        (1, message(text.upper())), (2, message("\n".join(f"> {a} {b}," for a, b in zip(part[::2], part[1::2])))), (3, message(html, "Content-Type: text/html")),
        (4, message(b64, "Content-Transfer-Encoding: base64")), (5, message(quopri.encodestring(("x=" + " ".join(part)).replace("x=", "= ").encode()).decode(), "Content-Transfer-Encoding: quoted-printable")),
        (6, message(f"pre\n--bb\nContent-Type: text/plain\n\nhello\n--bb\nContent-Type: text/plain; name=a\nContent-Transfer-Encoding: base64\n\n{b64}", mixed)),
        (7, message(" ".join(part[:6]) + "\n--bb\n\n" + " ".join(part[6:]))), (8, message(" ".join(part[:6] + ["other"] + item[12:18]))), (9, message(" ".join(part[:11]))),
        (10, message(f"--bb\nContent-Type: image/png\nContent-Transfer-Encoding: base64\n\n{b64}\n--bb--", mixed)), (11, None), (12, ""), (13, text.replace("o", "о")), (1, message(text)),
        (None, text), (14, message(" ".join(part[:6]) + "\n--bb\nContent-Type: text/plain\n\n" + " ".join(part[6:]), mixed)),
    ]
    items = [(1, " ".join(item)), (2, " ".join(item[:11])), (3, None), (4, ""), (5, " ".join(item[4:20])), (None, text)]
    got = run(spark, docs, items)
    assert got == sorted((d, i) for d in (1, 2, 3, 4, 5, 6, 13) for i in (1, 5))
    assert {d for d, i in run(spark, docs, items, slop=1) if i == 1} == {1, 2, 3, 4, 5, 6, 7, 8, 13}


def in_order(doc, item, run, slop):
    """Brute force: run words of the item in order, within run + slop words of both."""
    size = run + slop
    for i in range(max(len(item) - run + 1, 0)):
        for p in range(max(len(doc) - run + 1, 0)):
            x, y = item[i : i + size], doc[p : p + size]
            if x[0] != y[0]:
                continue
            # Longest common subsequence that begins with both first words.
            table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            for a in range(len(x) - 1, -1, -1):
                for b in range(len(y) - 1, -1, -1):
                    table[a][b] = table[a + 1][b + 1] + 1 if x[a] == y[b] else max(table[a + 1][b], table[a][b + 1])
            if table[0][0] >= run:
                return True
    return False


def test_near_passages(spark):
    """Words left out, put in or changed: as many documents are found as by brute force."""
    r = random.Random(11)
    items = [(i, " ".join(sentence(r, 20))) for i in range(15)]
    docs = []
    for d in range(150):
        ws, part = sentence(r, 15), r.choice(items)[1].split()[3:17]
        for _ in range(r.randrange(3)):
            k = r.randrange(1, len(part) - 1)
            part[k : k + 1] = r.choice([[], [r.choice(WORDS)], [part[k], r.choice(WORDS)]])
        ws[7:7] = part[: r.randrange(10, 15)]
        docs.append((d, message(" ".join(ws))))
    body = {d: t.split("\n\n")[1].split() for d, t in docs}
    want = sorted((d, i) for d in body for i, t in items if in_order(body[d], t.split(), 10, 1))
    got = run(spark, docs, items, run=10, slop=1)
    assert len(want) > 60 and set(got) <= set(want) and len(got) >= 0.9 * len(want)
    print(len(got), len(want))


def test_each_kind_of_change(spark):
    r = random.Random(12)
    item = [f"w{i}" for i in range(14)]
    part = item[1:13]
    docs = [(1, part[:5] + ["zz"] + part[5:]), (2, item[1:6] + item[7:14]), (3, item[1:6] + ["zz"] + item[7:14]), (4, item[1:5] + item[6:8] + ["zz"] + item[8:14]), (5, part[:5] + ["zz", "yy"] + part[5:])]
    got = run(spark, [(d, message(" ".join(ws))) for d, ws in docs], [(1, " ".join(item))], slop=1)
    assert got == [(1, 1), (2, 1), (3, 1), (4, 1)]


def test_deep_parts_and_blocks(spark, monkeypatch):
    text = " ".join(f"q{i}" for i in range(12))
    deep = message(text)
    for i in range(20):
        deep = message(f"\n--b{i}x\n{deep}\n--b{i}x--", f'Content-Type: multipart/mixed; boundary="b{i}x"')
    monkeypatch.setattr(leakage, "BLOCK", 20)
    docs = [(1, deep), (2, message(text))] + [(d, message("q0 q1 q2 " + "other " * d)) for d in range(3, 30)]
    assert run(spark, docs, [(1, text)]) == [(1, 1), (2, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    words = leakage.index(d, "doc_id", "text").selectExpr("sum(n) n").first()["n"]
    assert words == sum(len(leakage.words(b)) for _, t in docs for b, _ in mail.texts(t))


def test_same_as_all_pairs(spark):
    r = random.Random(9)
    items = [(i, " ".join(sentence(r, r.choice([3, 6, 12])))) for i in range(12)]
    docs = []
    for d in range(60):
        ws = sentence(r, 25)
        if r.random() < 0.6:
            take = r.choice(items)[1].split()
            k = r.randrange(3, len(take) + 1)
            ws[5:5] = take[:k]
        docs.append((d, message(" ".join(ws))))
    body = {d: t.split("\n\n")[1].split() for d, t in docs}

    def shares(a, b, run=5):
        grams = {tuple(a[i : i + run]) for i in range(len(a) - run + 1)}
        return any(tuple(b[i : i + run]) in grams for i in range(len(b) - run + 1))

    want = sorted((d, i) for d in body for i, t in items if shares(t.split(), body[d]))
    assert want and run(spark, docs, items, run=5) == want
    assert run(spark, docs, items, run=5, probes=1) == want


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a " * 12)]) == [] and run(spark, [(1, "a " * 12)], []) == []


def test_broken_mail_does_not_crash():
    for x in ("", "\n", "From: a", "From: a\n\n", "a: b\nContent-Type: multipart/mixed\n\nx", "a: b\nContent-Transfer-Encoding: base64\n\n=====", "<" * 50, "--\n--\n\n"):
        assert isinstance(mail.texts(x), list)
