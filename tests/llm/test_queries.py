"""Every registered operator query on edge rows, against brute force, and on empty tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest

from fairplay.llm.queries import QUERIES
from tests.llm import brute

DOCUMENT_QUERIES = sorted(QUERIES)


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).collect() == []


def run(spark, path, name):
    return [tuple(r) for r in QUERIES[name](spark, path).collect()]


def some(value):
    return Counter(value)


def test_top_k(spark, edge_dir):
    rows = [tuple(r)[:2] for r in spark.read.parquet(f"{edge_dir}/embeddings.parquet").collect()]
    assert sorted(run(spark, edge_dir, "op1_exact_top_k")) == brute.top_k(rows)


def test_html(spark, edge_dir):
    got = run(spark, edge_dir, "op2_html_extraction")
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{edge_dir}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for page_id, _, text, n_chars, *_ in got:
        assert n_chars == len(text)
        if page_id is not None and page_id < 90:
            assert text == brute.article(pages[page_id])
        elif page_id in (90, 91):
            assert text == ""


def test_quality(spark, edge_dir, docs):
    got = run(spark, edge_dir, "op3_weak_supervision_quality")
    assert some(r[:7] for r in got) == some((i, *brute.measures(t)) for i, t, _ in docs)
    assert not any(r[7] for r in got if r[6])


def test_sharding(spark, edge_dir, docs):
    got = run(spark, edge_dir, "op4_feistel_sharding")
    assert some(r[:3] for r in got) == some((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in docs)
    slots = defaultdict(list)
    for _, _, _, law, shard, slot, grown in got:
        assert law == "rows" and grown is None
        slots[shard].append(slot)
    sizes = [len(slots[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert some(got) == some(run(spark, edge_dir, "op4_feistel_sharding"))


def test_ppm(spark, edge_dir, docs):
    got = run(spark, edge_dir, "op5_ppm_scoring")
    want = brute.ppm([d[:2] for d in docs])
    assert some(r[:5] for r in got) == some((d[0], *w[:4]) for d, w in zip(docs, want))
    key = lambda i, n, a: (i is None, i or 0, n, round(a, 3))
    for g, w in zip(sorted((key(r[0], r[2], r[5]), r[5], r[6]) for r in got),
                    sorted((key(d[0], w[1], w[4]), w[4], w[5]) for d, w in zip(docs, want))):
        assert math.isclose(g[1], w[1], rel_tol=1e-9) and math.isclose(g[2], w[2], rel_tol=1e-9)


def test_sentencepiece(spark, edge_dir, docs):
    got = run(spark, edge_dir, "op6_sentencepiece_codec")
    assert some(r[:4] for r in got) == some((d[0], *w) for d, w in zip(docs, brute.sentencepiece_rows([d[1] for d in docs])))
    assert some((r[0], r[4]) for r in got) == some((i, len((t or "").encode())) for i, t, _ in docs)


def test_mixing(spark, edge_dir, docs):
    got = run(spark, edge_dir, "op7_source_mixing")
    assert some(r[:2] for r in got) == some((i, len(brute.words(t))) for i, t, _ in docs)
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(brute.words(t))
    want = brute.targets(sizes)
    assert some((round(r[2]), round(r[3], 6)) for r in got) == some((sizes[s], round(want[s], 6)) for _, _, s in docs)
    assert all(r[4] <= 2 * r[1] for r in got)
    taken, biggest = Counter(), Counter()
    for r in got:
        taken[round(r[3], 6)] += r[4]
        biggest[round(r[3], 6)] = max(biggest[round(r[3], 6)], r[1])
    of = Counter(round(t, 6) for t in want.values())
    assert all(abs(taken[t] - t * n) <= n * biggest[t] for t, n in of.items() if biggest[t])
    assert some(got) == some(run(spark, edge_dir, "op7_source_mixing"))


def test_token_files(spark, edge_dir, docs):
    got = sorted(run(spark, edge_dir, "op8_token_files"), key=lambda r: r[1])
    texts = defaultdict(list)
    for i, t, _ in docs:
        texts[i].append((len(brute.token_rows([t])), brute.token_rows([t])[0][1:]))
    at = 0
    for i, start, n, crc in got:
        assert start == at
        assert (n, crc) in [x[1] for x in texts[i]]
        at += n
    assert [r[0] for r in got] == sorted((d[0] for d in docs), key=lambda i: (i is not None, i or 0))


def test_suffix_dedup(spark, edge_dir, docs):
    got = run(spark, edge_dir, "op9_suffix_dedup")
    want = brute.repeats([d[1] for d in docs])
    passages = brute.repeats([d[1] for d in docs], 225, 51)
    assert any(p[2] for p in passages)
    assert some(got) == some((d[0], *w[:3], hashlib.sha256(w[3]).hexdigest(), p[2]) for d, w, p in zip(docs, want, passages))


def test_simhash(spark, edge_dir, docs):
    got = run(spark, edge_dir, "op10_simhash_near_dedup")
    fps = [brute.simhash(d[1]) for d in docs]
    roots = brute.groups(fps)
    low = {r: min((d[0] for d, g in zip(docs, roots) if g == r and d[0] is not None), default=None) for r in set(roots)}
    assert some(got) == some((d[0], f"{f:016x}", low[r]) for d, f, r in zip(docs, fps, roots))
