"""Fill-in-middle against a plain Python version, round trips, odd texts."""
import hashlib
import re

from pyspark.sql import functions as F

from loomtab.llm import fill_middle as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(key, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    n = len(units)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_plain_version(spark):
    odd = ["", None, " ", "\n\n", "one", " one ", "a\tb\x0bc\x0c d\r\n", "<P> x", "a <S>b", "c<M>", "< P>", "<", "x <", "<S <P <M", "> P> S>",
           "é à 漢字 \U0001f600 \U0001f600\U0001f601 x", " non breaking wide", "$1 \\1 ${a} \\", "(?s)\\A[a]{3}+", "a\u0085b c", "tie tie tie"]
    rows = [(100 * r + i, t, i) for r in range(12) for i, t in enumerate(odd)]
    rows += [(7, "same key again", 1), (7, "same key again", 1), (None, "no key at all", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    got = M.fill_in_middle(df).withColumn("back", M.restore(F.col("output"), F.col("form"))).collect()
    want = sorted(((k, *plain_version(k, t), t or "") for k, t, _ in rows), key=repr)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got), key=repr) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_very_long_texts(spark):
    rows = [(i, t) for i in range(6) for t in ("word " * 400_000, "x" * 1_000_000, " " * 300_000, "\n a" * 200_000)]
    got = M.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((k, *(v := plain_version(k, t))[:4], sha(v[4]), sha(t)) for k, t in rows)
    assert sorted(map(tuple, got)) == want


def test_other_columns_and_empty_tables(spark):
    names = "own, body, h, before, middle, form, output, doc_id, text, a.b"
    df = spark.createDataFrame([("o", "b", "h", 1, 2, "f", "out", 5, "some words here", 3)], "own string, body string, h string, before int, middle int, form string, output string, doc_id long, text string, `a.b` int")
    r = M.fill_in_middle(df).first()
    assert (r.own, r.body, r.h, r.before, r.middle, r["a.b"]) == ("o", "b", "h", 1, 2, 3), names
    assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_version(5, "some words here")
    assert M.fill_in_middle(df.limit(0)).count() == 0
    assert M.fill_in_middle(df.select("doc_id", "text")).columns == ["doc_id", "output", "n", "form", "prefix_chars", "middle_chars"]
