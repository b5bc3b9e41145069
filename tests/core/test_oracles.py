"""Every registered query of the engine against its DuckDB SQL on the smallest tables."""

import math
import os
from pathlib import Path

import pytest

from prosemill.plans import registry

duckdb = pytest.importorskip("duckdb")
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, tables, name):
    got = registry.queries()[name](spark, str(DATA))
    cursor = tables.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    want = sorted(str([plain(dict(zip(names, row, strict=True))[c]) for c in order]) for row in cursor.fetchall())
    have = sorted(str([plain(r[c]) for c in order]) for r in got.collect())
    assert have == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert len(registry.queries()[name](spark, str(DATA)).take(1)) == 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streams(spark, tmp_path):
    from prosemill.operators import facts
    from prosemill.streaming import documents

    source = tmp_path / "in"
    batch = spark.read.parquet(str(DATA / "documents.parquet"))
    batch.repartition(3).write.parquet(str(source))
    stream = documents.document_stream(spark, str(source))
    documents.per_batch(stream, facts.facts, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == facts.facts(batch).count()
    q = documents.scored_stream(stream).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("scored").count() == batch.count()


def test_readers(spark, tmp_path):
    import zipfile

    from prosemill.sources import readers

    (tmp_path / "a.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "b.md").write_text("# x")
    (tmp_path / "c.html").write_text("<head><title>t</title></head><p>a &amp; b</p><script>x</script><p>c</p>")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>")
    (tmp_path / "e.docx").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert [got[k].text for k in ("a.txt", "b.md", "c.html", "d.docx", "e.docx")] == ["é", "# x", "a & b\nc", "one\n\ntwo", None]
    assert got["e.docx"].error and got["b.md"].format == "markdown"
