from tetrad.operators.engine import Store, StorePool
from tetrad.streaming.ingest import ingest


def test_files_arrive_in_turn(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, line in enumerate(["<a:s> <a:p> <a:o> .\n", '<a:s> <a:p> <a:o> .\n<a:s> <a:p> "2" <a:g> .\n']):
        (tmp_path / "in" / f"{i}.nq").write_text(line)
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "checkpoint"), f"2024-01-0{i + 1} 00:00:00").awaitTermination()
    store = Store.open(spark, str(tmp_path / "store"))
    assert store.query("SELECT * WHERE { ?s ?p ?o }").count() == 1
    assert store.graphs().first()[0] == "<a:g>"


def test_pool(spark, tmp_path):
    pool = StorePool(spark, str(tmp_path))
    pool.get_or_create("x").update("INSERT DATA { <a:s> <a:p> 1 }")
    pool.save("x")
    assert StorePool(spark, str(tmp_path)).get_or_create("x").table.count() == 1
    pool.switch("y")
    pool.delete("x")
    assert pool.active == "y"
