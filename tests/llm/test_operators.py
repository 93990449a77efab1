"""Operators with parameters that reach their rarer paths, and their own outputs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from fairplay.llm import html_text, pieces, sharding, simhash, suffix_dedup, token_files
from tests.llm import brute


def test_feistel_is_a_permutation_for_any_size(spark):
    for n in (1, 2, 3, 5, 17, 100, 257):
        df = spark.range(n).withColumnRenamed("id", "k")
        got = sorted((r["shard"], r["slot"]) for r in sharding.shard(df, "k", [], shards=3, seed=n).collect())
        assert got == sorted((i % 3, i // 3) for i in range(n))


def test_links_of_large_buckets_lose_nothing(spark):
    r = random.Random(1)
    base = r.getrandbits(64)
    fps = {base}
    for _ in range(300):
        f = base
        for _ in range(r.randint(1, 5)):
            f ^= 1 << r.randrange(64)
        fps.add(f)
    fps = sorted(fps | {r.getrandbits(64) for _ in range(200)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = brute.groups(fps)
    for limit, segments in ((4, 8), (64, 8), (10_000, 4), (4, 16)):
        pairs = [(tuple(x)) for x in simhash.links(df, 2, segments, limit).collect()]
        assert all(((u ^ v) & (1 << 64) - 1).bit_count() <= 2 for u, v in pairs)
        place = {s: i for i, s in enumerate(signed)}
        root = list(range(len(fps)))

        def find(x):
            while root[x] != x:  # noqa: B023
                x = root[x]  # noqa: B023
            return x

        for u, v in pairs:
            a, b = find(place[u]), find(place[v])
            root[max(a, b)] = min(a, b)
        assert [find(i) for i in range(len(fps))] == want


def test_one_of_each_group_stays(spark, edge_dir):
    df = spark.read.parquet(f"{edge_dir}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    roots = brute.groups([brute.simhash(t) for _, t in rows])
    assert len(got) == len(set(roots))
    for g in set(roots):
        ids = [i for (i, _), r in zip(rows, roots) if r == g]
        assert min(ids, key=lambda i: (i is None, i or 0)) in [i for i, _ in got]


@pytest.mark.parametrize("how", [{"class_limit": 3, "per_range": 2}, {"per_range": 3, "per_part": 5}, {"length": 100, "class_limit": 4, "per_range": 3},
                                 {"length": 32}, {"length": 700, "per_range": 5}, {"length": 60, "least_words": 12}])
def test_suffix_dedup_with_frequent_classes_and_small_ranges(spark, edge_dir, docs, how, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FAN_IN", 2)
    monkeypatch.setattr(suffix_dedup, "BATCH", 50)
    df = spark.read.parquet(f"{edge_dir}/documents.parquet")
    got = sorted((str(r[0]), *tuple(r)[1:4]) for r in suffix_dedup.removed(df, **how).collect())
    want = brute.repeats([d[1] for d in docs], how.get("length", 400), how.get("least_words", 0))
    assert got == sorted((str(d[0]), *w[:3]) for d, w in zip(docs, want))


@pytest.mark.parametrize("how", [{"class_limit": 3, "per_range": 2}, {}])
def test_two_lengths_in_one_order(spark, edge_dir, docs, how):
    df = spark.read.parquet(f"{edge_dir}/documents.parquet")
    got = sorted((str(r[0]), r[2], r[3], r[5]) for r in suffix_dedup.removed(df, length=300, passages=(90, 5), **how).collect())
    one, two = (brute.repeats([d[1] for d in docs], *x) for x in ((300, 0), (90, 5)))
    assert got == sorted((str(d[0]), a[1], a[2], b[2]) for d, a, b in zip(docs, one, two))


def test_ends_of_texts_are_no_zero_bytes(spark):
    """A text that ends where another has zero bytes does not share them."""
    base = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(230))
    rows = [(0, base), (1, base + "\0" * 200), (2, "x" + base + "\0" * 100 + "y" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in suffix_dedup.removed(df, length=100, passages=(250, 0)).select("doc_id", "n_removed", "n_passages").collect())
    one, two = (brute.repeats([t for _, t in rows], n) for n in (100, 250))
    assert got == [(i, a[1], b[2]) for (i, _), a, b in zip(rows, one, two)]


def test_loser_tree_merges_and_folds():
    r = random.Random(2)
    runs, all_items = [], {}
    for i in range(7):
        items = {}
        for _ in range(r.randint(0, 60)):
            s = bytes(r.choice(b"ab") for _ in range(12)).ljust(594, b"\0")
            items[s] = bytes([i]) * 20
        if items:
            runs.append(suffix_dedup.front_coded(sorted(items.items())))
        for s, o in items.items():
            all_items.setdefault(s, []).append(o)
    got = list(suffix_dedup.merged(runs))
    assert [s for s, _, _ in got] == sorted(all_items)
    for (a, _, _), (b, n, occ) in zip(got, got[1:]):
        assert n == next(i for i in range(len(a)) if a[i] != b[i])
        assert sorted(occ[i:i + 20] for i in range(0, len(occ), 20)) == sorted(all_items[b])


def double_array(mapping):
    """A compiled character map for the tests: a trie with one wide block per node."""
    trie = {0: {}}
    values, replacements = {}, b""
    for key, new in mapping.items():
        node = 0
        for byte in key:
            if byte not in trie[node]:
                trie[node][byte] = len(trie)
                trie[len(trie)] = {}
            node = trie[node][byte]
        values[node] = len(replacements)
        replacements += new + b"\0"
    size = 256 * (len(trie) + 1)
    units = [0x80000000 | 255] * size
    place = {0: 0}
    units[0] = 0

    def offset(at, node):
        return at ^ (256 * (node + 1))

    todo = [0]
    while todo:
        node = todo.pop()
        at = place[node]
        off = offset(at, node)
        units[at] = units[at] & 0x800000FF if at else 0
        units[at] |= (off << 10) | (256 if node in values else 0)
        if node in values:
            units[at ^ off] = 0x80000000 | values[node]
        for byte, child in trie[node].items():
            place[child] = at ^ off ^ byte
            units[place[child]] = byte
            todo.append(child)
    blob = np.array(units, "<u4").tobytes()
    return len(blob).to_bytes(4, "little") + blob + replacements


def test_character_map_takes_the_longest_prefix_and_keeps_sources():
    charmap = pieces.CharMap(double_array({"ﬁ".encode(): b"fi", b"ab": b"X", b"abc": b"", b"\t": b" "}))
    assert charmap.longest(b"abcd", 0) == (3, b"")
    assert charmap.longest(b"abd", 0) == (2, b"X")
    assert charmap.longest(b"zab", 0) is None
    n = pieces.Normalizer(b"")
    n.charmap, n.prefix, n.trim = charmap, True, False
    normal, source = n("zﬁ\tab")
    assert normal.decode() == "▁zfi▁X"
    assert source == [0, 0, 0, 0, 1, 1, 4, 4, 4, 5, 7]


def test_pieces_tile_the_original_bytes(spark):
    import public_tokenizers

    texts = ["", "a b", "  two  spaces ", "日本 😀\nline", "▁mark ▁ x", "word " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode(df, path)
    for r in encoded.collect():
        raw = texts[r["doc_id"]].encode()
        if raw:
            assert r["starts"][0] == 0 and r["ends"][-1] == len(raw)
            assert r["starts"][1:] == r["ends"][:-1]
    back = {r["doc_id"]: r["text"] for r in pieces.decode(encoded, path).collect()}
    assert back == dict(enumerate(texts)) or all(back[i] == t.replace("▁", " ") for i, t in enumerate(texts))


def test_token_files_encodings_hold_the_same_ids(spark, tmp_path):
    import pyarrow.parquet as pq
    import public_tokenizers

    df = spark.createDataFrame([(i, f"some words number {i} " * (i % 7)) for i in range(50)], "doc_id long, text string")
    rows = []
    for e in ("dictionary", "delta"):
        path = str(tmp_path / e)
        token_files.write(df, public_tokenizers.path("word_bpe_49k.json"), path, 2, encoding=e)
        rows.append(sorted(map(tuple, token_files.read_back(spark, path).collect())))
        column = pq.ParquetFile(next((tmp_path / e).glob("part-*.parquet"))).metadata.row_group(0)
        ids = next(column.column(i) for i in range(column.num_columns) if column.column(i).path_in_schema.startswith("ids"))
        assert ("DELTA_BINARY_PACKED" if e == "delta" else "RLE_DICTIONARY") in str(ids.encodings) or "PLAIN_DICTIONARY" in str(ids.encodings)
        assert ids.has_offset_index
    assert rows[0] == rows[1]


@pytest.fixture(scope="session")
def page_model(spark):
    return html_text.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


@pytest.fixture(scope="session")
def some_pages(spark):
    return [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]


def extracted(source, model, messages=True):
    page = html_text.Page(source)
    if messages:
        return page.text([p >= 0.5 for p in html_text.marginals(page, model)])
    return page.text([sum(model[x][1] - model[x][0] for x in found if x in model) >= 0 for found in page.features()])


def test_marginals_equal_enumeration(page_model):
    """All labellings of trees of up to 10 elements."""
    import itertools
    import math

    r = random.Random(4)
    tags = ["div", "p", "nav", "article", "a", "b", "section", "footer", "ul", "li", "h1"]
    for size in [1, 2, 3, 4, 5, 7, 8, 9, 9, 9] * 3:
        source, opened = "", []
        for _ in range(size):
            while opened and r.random() < 0.35:
                source += f"</{opened.pop()}>"
            opened.append(r.choice(tags))
            source += f'<{opened[-1]} class="{r.choice(["", "ad", "content", "x"])}">' + r.choice(["", "word ", "Some words of text. " * 6])
        page = html_text.Page(source)
        n = len(page.tags)
        unary = [[sum(page_model[x][y] for x in found if x in page_model) for y in (0, 1)] for found in page.features()]
        total, yes = 0.0, [0.0] * n
        for labels in itertools.product((0, 1), repeat=n):
            w = -2.0 * labels[0]
            for e, y in enumerate(labels):
                w += unary[e][y]
                if e:
                    w += page_model["pair", f"{page.kind(e)} {labels[page.parents[e]]}"][y]
            w = math.exp(w)
            total += w
            yes = [v + w * y for v, y in zip(yes, labels)]
        assert html_text.marginals(page, page_model) == pytest.approx([v / total for v in yes], abs=1e-9)


def test_text_does_not_hang_on_marks(page_model, some_pages):
    import re

    def neutral(source, also_article):
        for a, b in [("<nav>", "<div>"), ("</nav>", "</div>"), ("<footer>", "<div>"), ("</footer>", "</div>"), (' class="ad"', "")]:
            source = source.replace(a, b)
        return source.replace("<article>", "<div>").replace("</article>", "</div>") if also_article else source

    want = [brute.article(x) for x in some_pages]
    assert [extracted(x, page_model) for x in some_pages] == want
    assert [extracted(neutral(x, False), page_model) for x in some_pages] == want
    right = sum(extracted(neutral(x, True), page_model) == w for x, w in zip(some_pages, want))
    assert right >= 0.9 * len(want)
    changed = sum(extracted(neutral(x, True), page_model) != extracted(neutral(x, True), page_model, False) for x in some_pages)
    assert changed > 0.5 * len(want)  # what messages do
    for word in ("social", "comment", "search", "legal", "related", "share"):  # on a paragraph, a word is a hint
        marked = [re.sub(r"(<article><h1>.*?</h1>)<p>", rf'\1<p class="{word}">', x, flags=re.S) for x in some_pages[:40]]
        assert marked[0] != some_pages[0]
        assert [extracted(x, page_model) for x in marked] == want[:40]
    inside = ('<div class="ad">Buy it now.</div><aside><p>Another text of some words.</p></aside><form><p>Send a letter.</p></form>'
              '<section class="comments"><h3>Comments</h3><div class="comment"><p>Very good, thanks.</p></div></section>')
    assert [extracted(x.replace("</article>", inside + "</article>"), page_model) for x in some_pages[:40]] == want[:40]


def test_html_without_labelled_pages(spark):
    """The expectations alone, and no article element."""
    model = html_text.train(spark.createDataFrame([("<p>x",)], "html string"))
    page = ('<body><div class="sidebar"><p>' + "related " * 90 + "</p></div><div>" + ("<p>" + "Main text, a sentence of words. " * 9 + "</p>") * 4 + "</div></body>")
    assert extracted(page, model) == "\n".join([("Main text, a sentence of words. " * 9).strip()] * 4)


def test_words_are_encoded_as_the_library_does():
    import itertools

    import public_tokenizers

    words = token_files.Words(open(public_tokenizers.path("word_bpe_49k.json")).read())
    assert words.plain is not None
    odd = ["a'b", "don't", "I'LL", "İx", "ıI", "×a", "x9y", "a--b", "e\u0301", "ß", "ẞ", "ŉ", "ſ", "µ", "ª", "Σας", "<|endoftext|>", "a<|endoftext|>b",
           "<|startoftext|>x", "日本", "a\u00a0b", "a\u3000b", "...", "a,b.c", "A" * 100, "'s", "\u0301a", "\u212b", "a\x7fb", "\x00"]
    odd += ["".join(p) for p in itertools.product("aÉ'.9<|ñ", repeat=3)]
    odd += [x for c in range(0x21, 0x600) for x in (chr(c), f"a{chr(c)}B")]
    texts = [None, "", " \t\x0b", *odd, *(" ".join(odd[i:i + 40]) for i in range(0, len(odd), 40)), " x  y\n", None]
    want = [e.ids for e in words.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]

    def got():
        values, ends = words.encode(pa.array(["left out", *texts], pa.string()).slice(1))
        return [values[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)]

    assert got() == want
    words.known, words.older = {}, words.known  # the older generation is used
    assert got() == want
    words.known, words.older, words.plain, words.between = {}, {}, None, None  # another file: plain calls
    assert got() == want
    assert [len(x) for x in words.encode(pa.array([], pa.string()))] == [0, 0]


def test_token_files_are_read_selectively(spark, tmp_path):
    import public_tokenizers

    df = spark.createDataFrame([(i, f"some words number {i} " * 30) for i in range(4000)], "doc_id long, text string")
    path = str(tmp_path / "tokens")
    token_files.write(df, public_tokenizers.path("word_bpe_49k.json"), path, 2, page_bytes=2048)
    whole = {r["doc_id"]: r["ids"] for r in spark.read.parquet(path).collect()}
    some = token_files.documents(spark, path, 700, 705)
    assert {r["doc_id"]: r["ids"] for r in some.collect()} == {i: whole[i] for i in range(700, 706)}
    scan = some._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() < 400  # of 4000: pages of other keys are skipped
    rows = token_files.metadata(spark, path)
    assert "ids" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: r["n_tokens"] for r in rows.collect()} == {i: len(x) for i, x in whole.items()}


def test_token_files_split_a_hot_key(spark, tmp_path):
    """A third of the rows share a key: their texts are in several files."""
    import public_tokenizers

    df = spark.createDataFrame([(7 if i % 3 == 0 else i, f"word {i}") for i in range(3000)], "doc_id long, text string")
    path = str(tmp_path / "tokens")
    token_files.write(df, public_tokenizers.path("word_bpe_49k.json"), path, 2)
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy("file").count().collect()]
    assert max(sizes) < 1000
