"""Token attribution against the tokenizer's own offsets."""
import pytest
from tokenizers import Tokenizer

from loomtab.llm.token_counts import count_tokens
from loomtab.llm.tokens import encoder, tokenizer_path

TEXTS = [None, "", "one line", "a\nb  c\n\n d é\n", "<|endoftext|> x's\t\t ü\n日本語 text 😀\n", "word " * 3000, "one line", "\n", "  \n  x"]


def brute(tok, fields, rule, inside):
    doc = "\n".join(f or "" for f in fields)
    enc = tok.encode(doc, add_special_tokens=False)
    bounds, at = [0], 0
    for f in fields[:-1]:
        at += len(f or "") + 1
        bounds.append(at)
    bounds.append(len(doc))
    starts = bounds[:-1] + ([i + 1 for i, c in enumerate(doc) if c == "\n" and i + 1 not in bounds] if inside else [])
    starts = sorted(starts)
    out = [0] * len(starts)
    for a, b in enc.offsets:
        at = a if rule == "first" else b - 1
        out[max(i for i, s in enumerate(starts) if s <= at)] += 1
    return len(enc.ids), out


def test_ids_are_those_of_the_whole_text():
    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    texts = [t for t in TEXTS if t is not None] + ["a  b", " a b ", "x \n y", "it's 'tis don't", "1 2  3\t4", "a b  c", "naïve—dash “q”"]
    got = encoder(tokenizer_path()).encode(texts)
    assert [list(memoryview(g).cast("I")) for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("rule", ["first", "last", "split"])
@pytest.mark.parametrize("inside", [False, True])
def test_sections(spark, rule, inside):
    ascii_only = [t for t in TEXTS if t is None or t.isascii()]
    rows = [(i, t, "src" if i % 2 else None, 7) for i, t in enumerate(ascii_only)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int")
    got = {r.doc_id: r for r in count_tokens(df, ["source", "text"], inside=inside, rule=rule).collect()}
    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    assert len(got) == len(rows)
    for i, t, s, _ in rows:
        n, want = brute(tok, [s, t], rule, inside)
        tokens = [x.tokens for x in got[i].sections]
        assert got[i].n_tokens == n and abs(sum(tokens) - n) < 1e-6
        if rule != "split":
            own = [x for x in tokens if True]
            assert [x for x in own if x] == [x for x in want if x], (i, own, want)
    assert count_tokens(df.limit(0), ["text"]).count() == 0


def test_other_scripts_and_rules(spark):
    df = spark.createDataFrame([(0, "日本語 text 😀\nü")], "doc_id long, text string")
    row = count_tokens(df, ["text"], inside=True).first()
    assert sum(s.tokens for s in row.sections) == row.n_tokens and len(row.sections) == 2
    with pytest.raises(ValueError):
        count_tokens(df, ["text"], rule="other")
