"""The tokenizer against the reference implementation of its vocabulary; mixes against their definition."""

import base64
import os
from collections import defaultdict

import pytest
import tiktoken

from lingualoom.llm import mixing as M
from lingualoom.llm import vocabulary as V

PATH = f"{V.TOKENIZERS}/{V.VOCABULARY}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")
TEXTS = ["Hallo Welt!", "", None, " ", "\x00a\x00", "a" * 100_000, "漢字かな" * 3000, "<|endoftext|> ▁Āǿ é 😀\r\n\t  x", "İſ", "    x y", "don't I'LL we've", "1234567 89", "\n\n\n", "Żółć — «да»…"]


def test_ids_and_way_back(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    truth = tiktoken.Encoding("own", pat_str=V.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS + TEXTS)], "doc_id long, text string, out string")
    got = {r.doc_id: list(r.ids) for r in V.encode(df).collect()}
    assert len(got) == 2 * len(TEXTS)
    for k, t in enumerate(TEXTS + TEXTS):
        assert got[k] == (truth.encode_ordinary(t) if t else [])
    back = {r.doc_id: r.text for r in V.decode(V.encode(df)).collect()}
    assert all(back[k] == (t or "") for k, t in enumerate(TEXTS + TEXTS))
    assert {r.doc_id: r.tokens for r in V.token_counts(df).collect()} == {k: len(v) for k, v in got.items()}
    assert V.encode(df.limit(0)).count() == 0


def test_all_bytes_have_letters():
    assert len({V.as_letters(bytes([b])) for b in range(256)}) == 256


TARGETS = [("m", "a", 0.5, 1), ("m", "b", 0.5, 3), ("p", "a", 60.0, 2), ("p", "b", 30.0, 1), ("p", "none", 10.0, 5), ("d", "a", 0.2, 2), ("d", "a", 0.3, 1), ("d", None, 0.5, 1), ("n", "a", None, 1), ("z", "b", 1.0, None)]


def sizes(spark):
    rows = [(k, "a" if k % 3 else "b", 1 + k * 7 % 40) for k in range(900)] + [(5000, "a", 0), (5001, None, 9)]
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long")


def test_shares_repeats_and_nesting(spark):
    docs = M.with_hash(sizes(spark))
    targets = spark.createDataFrame(TARGETS, "mix_name string, source string, target_share double, max_repeats int")
    ends = M.thresholds(docs, M.budgets(docs, targets))
    taken = M.mixed(docs, ends).collect()
    caps = {("m", "a"): 1, ("m", "b"): 3, ("p", "a"): 2, ("p", "b"): 1, ("d", "a"): 1, ("z", "b"): 1}
    total = defaultdict(int)
    for r in taken:
        assert 1 <= r.repeats <= caps[r.mix_name, r.source] and r.tokens > 0
        total[r.mix_name, r.source] += r.tokens * r.repeats
    for r in ends.collect():
        assert abs(total[r.mix_name, r.source] - (r.full * r.available + r.rest)) <= 40  # at most a document off
    report = {(r.mix_name, r.source): r for r in M.shares(docs, ends).collect()}
    assert report["p", "none"].tokens == 0 and abs(report["p", "none"].target_share - 0.1) < 1e-12
    assert abs(report["m", "a"].actual_share - 0.5) < 0.01 and abs(report["m", "b"].actual_share - 0.5) < 0.01
    assert ("n", "a") not in report
    # A larger total takes a superset, and a source that is too small gives all it may.
    def chosen(total):
        e = M.thresholds(docs, M.budgets(docs, targets.filter("mix_name = 'm'"), total))
        return {(r.doc_id, r.source): r.repeats for r in M.mixed(docs, e).collect()}
    small, large = chosen(2000), chosen(60_000)
    assert all(large.get(k, 0) >= v for k, v in small.items())
    assert all(v == 3 for (_, s), v in large.items() if s == "b")


def test_empty_tables(spark):
    docs = M.with_hash(sizes(spark))
    targets = spark.createDataFrame(TARGETS, "mix_name string, source string, target_share double, max_repeats int")
    assert M.mixed(docs.limit(0), M.thresholds(docs.limit(0), M.budgets(docs.limit(0), targets))).count() == 0
    assert M.shares(docs, M.thresholds(docs, M.budgets(docs, targets.limit(0)))).count() == 0
