"""The whole grid of 32 configurations against brute force over the similarities of a few pairs."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from lingualoom.operators import align as A
from lingualoom.operators import similarity as S
from lingualoom.plans.similarity import Inputs

SDS = (0.0, 1.5)


@pytest.fixture(scope="module")
def few(data, tmp_path_factory):
    """The data with the links of a few files only."""
    folder = tmp_path_factory.mktemp("few")
    for name in ("archive_header", "parsed_lines", "embeddings", "judgments"):
        pq.write_table(pq.read_table(f"{data}/{name}.parquet"), folder / f"{name}.parquet")
    judged = set(pq.read_table(f"{data}/judgments.parquet")["pair_hash"].to_pylist())
    from hashlib import sha1

    header = pq.read_table(f"{data}/archive_header.parquet")
    linked = [r["fname"] for r in header.to_pylist() if r["easy"] and any(sha1(f"{r['fname']}.txt___{m}.txt".encode()).hexdigest() in judged for m in r["matching_files"] or [])]
    kept = set(linked[:3])
    pq.write_table(header.filter([bool(not e or f in kept) for e, f in zip(header["easy"].to_pylist(), header["fname"].to_pylist())]), folder / "archive_header.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def want(spark, few):
    """(pair, measure, strategy, sd, i, j) of all configurations."""
    inputs, out = Inputs(spark, few), set()
    for measure in S.MEASURES:
        cells = defaultdict(dict)
        for r in inputs.sim(measure).collect():
            cells[r.pair_hash][r.i, r.j] = r.sim
        for pair, c in cells.items():
            m = np.array([[c[i, j] for j in range(1 + max(j for _, j in c))] for i in range(1 + max(i for i, _ in c))])
            for sd in SDS:
                x = m.mean() + sd * m.std()
                thr = max(0.0, round(float(x), 10)) if sd and not np.isnan(x) else 0.0
                tops = [(i, int(m[i].argmax())) for i in range(len(m))]
                out |= {(pair, measure, "max", sd, i, j) for i, j in tops if m[i, j] > thr}
                out |= {(pair, measure, "max_increasing_subsequence", sd, i, j) for i, j in A.ordered_alignment(np.where(np.isnan(m), -np.inf, m), thr)}
    return out


def test_whole_grid_has_all_configurations(spark, few, want):
    run = lambda name: entry.queries()[name](spark, few)
    assert {tuple(r) for r in run("matching_grid_whole").select("pair_hash", "measure", "strategy", "sd", "i", "j").collect()} == want
    counts = Counter(x[:4] for x in want)
    stats = {(r.pair_hash, r.measure, r.strategy, r.sd): r.n for r in run("match_stats_whole").collect()}
    pairs = {k[0] for k in stats}
    assert len(stats) == 32 * len(pairs) and {k: n for k, n in stats.items() if n} == counts
    full = {p for p in pairs if sum(k[0] == p for k in counts) == 32}
    assert {r.pair_hash for r in run("matched_skip_whole").collect()} == pairs - full
    assert {"measure", "max", "max_increasing_subsequence"} == set(run("precision_pivot_whole").columns)


def test_production_export_is_maximum_in_order(spark, few, want):
    run = lambda name: entry.queries()[name](spark, few)
    right = Counter(x[0] for x in want if x[1:4] == ("maximum", "max_increasing_subsequence", 1.5))
    lines = run("alignment_lines_production").collect()
    assert right and Counter(r.pair_hash for r in lines) == right
    assert sum(len(r.aligned) for r in run("alignment_export_production").collect()) == len(lines)
    total = next(r for r in run("aligned_counts_production").collect() if r.site is None)
    assert total.simple_sentences == sum(len({r.simple_sent for r in lines if r.pair_hash == p}) for p in right)
