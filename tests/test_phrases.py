"""Phrases against plain search, and the index kept up by document."""

import re

import pytest

from tessera.operators import text_index
from tessera.operators.text_index import PhraseIndex
from tessera.sources import published

DOCS = [(1, "The quick  brown fox, the quick", "x"), (2, "quick-brown fox", None), (3, None, "brown the fox"), (4, "a a a a", ""), (5, "雪地 靴 the fox", "quick")]
ASKED = [(1, "quick brown"), (2, "a a"), (3, "the fox"), (4, "靴 the"), (5, "missing words"), (6, "!")]


def plain(docs, asked=ASKED):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for key, *values in docs:
        for field, value in zip(("caption", "note"), values):
            w = words(value)
            for q, text in asked:
                p = words(text)
                out |= {(q, key, field, i) for i in range(len(w)) if p and w[i : i + len(p)] == p}
    return out


def rows(spark, docs):
    return spark.createDataFrame(docs, "doc int, text string, note string")


def hits(index, spark):
    return {tuple(r) for r in index.phrases(spark.createDataFrame(ASKED, "query_id int, text string")).collect()}


@pytest.fixture()
def index(spark, tmp_path):
    return PhraseIndex.build(rows(spark, DOCS), "doc", {"caption": "text", "note": "note"}, str(tmp_path / "p"))


def test_phrases(spark, index):
    assert hits(index, spark) == plain(DOCS)


def test_kept_up_by_document(spark, index):
    index = index.refresh(rows(spark, [(2, "a a", None), (9, "the fox", "quick brown")]))
    now = [d for d in DOCS if d[0] != 2] + [(2, "a a", None), (9, "the fox", "quick brown")]
    assert hits(index, spark) == plain(now)
    index = index.remove(rows(spark, [(4, None, None), (77, None, None)]))
    now = [d for d in now if d[0] != 4]
    assert hits(index, spark) == plain(now)
    index = index.refresh(rows(spark, [(4, "the fox", None)]))
    now.append((4, "the fox", None))
    assert hits(PhraseIndex.load(spark, index.path), spark) == plain(now) == hits(index.compacted(), spark)


def test_many_segments_become_one(spark, index, monkeypatch):
    monkeypatch.setattr(text_index, "MAX_SEGMENTS", 1)
    index = index.refresh(rows(spark, [(1, "a a", None)]))
    assert len(index.manifest["segments"]) == 1 and hits(index, spark) == plain([(1, "a a", None), *DOCS[1:]])


def test_a_lost_writer_leaves_the_last_index(spark, index, monkeypatch):
    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(text_index, "publish", lost)
    with pytest.raises(RuntimeError):
        index.refresh(rows(spark, [(1, "a a", None)]))
    assert hits(PhraseIndex.load(spark, index.path), spark) == plain(DOCS)


def test_the_term_index_survives_a_lost_driver(spark, tmp_path, monkeypatch):
    rows(spark, DOCS).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(text_index, "shared_root", lambda _: str(tmp_path / "shared"))
    make = lambda: text_index.index_of(spark, str(tmp_path / "docs"), docs, "doc", {"caption": "text"})
    with monkeypatch.context() as m:
        m.setattr(text_index, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            make()
    path = make()
    assert path == make() and spark.read.parquet(path).count() > 0
    assert published.newest(spark, path.rsplit("/", 1)[0])["folder"] == path.rsplit("/", 1)[1]
