import random

import pytest

COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, size long, shard int, fp long, h string, t string, "
           "k long, n_words long, kept boolean, copies long, target double, train boolean, batch int, block long, n long")


def documents():
    """Edge rows: nulls, empty and white texts, long texts, ties, repeated rows, passages."""
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefghiklmnoprstuwé") for _ in range(r.randint(1, 8))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", "", "", ",", "."]) for _ in range(n))
    passages = [prose(n) for n in (70, 80, 90, 150, 300)]
    texts = [None, "", " \t\n\x0b\x0c\r ", "A", "a  b", "Ünï ▁ code 日本 😀 <|endoftext|> l'été, it's.", "x" * 3000, "ab " * 900, "tail  ", "\n\n",
             prose(9000), passages[4]]
    for i in range(60):
        t = prose(r.randint(0, 160))
        if i % 3 == 0:
            t += " " + r.choice(passages) + " " + prose(r.randint(0, 40))
        if i % 7 == 0:
            t = "\n".join([t, "same line", "same line", ""])
        if i % 9 == 0:
            t = t.replace(" ", " ### ")
        texts.append(t)
    texts += [texts[20]] * 4 + [texts[21] + " more"] + [texts[10][:20000]]
    rows = [(i, t, "en", [None, "src0", "src1", "Ä", "src0", ""][i % 6], i % 5) for i, t in enumerate(texts)]
    rows += [rows[14], rows[14], (None, prose(90), None, None, None), (None, prose(100), "de", "src0", None), (None, None, None, None, None)]
    return [(*row, *[None] * 14) for row in rows]


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    """A folder of small tables with edge rows and clashing extra columns."""
    path = str(tmp_path_factory.mktemp("edge"))
    spark.createDataFrame(documents(), COLUMNS).repartition(5).write.parquet(f"{path}/documents.parquet")
    r = random.Random(3)
    vectors = [(i, [r.gauss(0, 1) for _ in range(6)], 0) for i in range(230)]
    vectors += [(300, [0.0] * 6, 0), (301, None, 0), (302, [1.0, None] * 3, 0), (303, [float("nan")] * 6, 0), (304, [float("inf")] * 6, 0)]
    vectors += [(400 + i, vectors[7][1], 0) for i in range(60)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, id long").repartition(4).write.parquet(f"{path}/embeddings.parquet")
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=/>menu</a></li></ul></nav><article><h1>{0}</h1><p>{1} &amp; more\n text<p>{2}</p></article><footer>foot {0}</footer></body></html>"
    pages = [(i, f"u{i}", page.format(f"Title {i}", "first part of the text, long enough to be read " * 3, "second part of it " * (i % 5)), "x") for i in range(40)]
    pages += [(90, None, None, None), (91, "u", "", None), (92, "u", "<div>" * 3000 + "deep", None), (None, "u", "<p title='x>broken <p", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string, text string").repartition(3).write.parquet(f"{path}/pages.parquet")
    items = [(i, " ".join(str(t).split()[i:i + 12]) if t else t, "x") for i, (_, t, *_) in enumerate(documents()[10:40])] + [(90, None, None), (91, "", None)]
    spark.createDataFrame(items, "item_id long, text string, bucket string").repartition(2).write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="session")
def empty_dir(spark, edge_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "embeddings", "pages", "benchmark"):
        spark.read.parquet(f"{edge_dir}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path


@pytest.fixture(scope="session")
def docs(spark, edge_dir):
    """(doc_id, text, source) rows of the edge table."""
    return [tuple(r) for r in spark.read.parquet(f"{edge_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
