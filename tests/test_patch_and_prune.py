import pytest

from tetrad.operators import access, prune
from tetrad.operators import quads as Q
from tetrad.operators.engine import Store
from tetrad.operators.patch import PatchConflict, apply_patch

PATCH = """@prefix solid: <http://www.w3.org/ns/solid/terms#>. @prefix ex: <http://e/>.
_:rename a solid:InsertDeletePatch; solid:where { ?p ex:name "Old". }; solid:deletes { ?p ex:name "Old". }; solid:inserts { ?p ex:name "New". }."""


def test_patch(spark):
    s = Store(spark)
    s.update('INSERT DATA { GRAPH <http://e/g> { <http://e/a> <http://e/name> "Old" } }', "2024-01-01 00:00:00")
    apply_patch(s, PATCH, "http://e/g", "2024-02-01 00:00:00")
    assert [r.n for r in s.query("SELECT ?n WHERE { GRAPH <http://e/g> { ?s <http://e/name> ?n } }").collect()] == ['"New"']
    with pytest.raises(PatchConflict):
        apply_patch(s, PATCH, "http://e/g")


def test_prune_history(spark):
    s = Store(spark)
    s.update("INSERT DATA { <a:s> <a:p> 1 . <a:s> <a:q> 2 }", "2024-01-01 00:00:00")
    s.update("DELETE DATA { <a:s> <a:p> 1 }", "2024-02-01 00:00:00")
    now = "2024-03-01 00:00:00"
    kept = {h: prune.prune(s.table, prune.PruneOptions(history=h), now) for h in prune.HISTORY}
    assert {h: d.count() for h, d in kept.items()} == {"flatten_to_current": 1, "preserve_versions": 1, "preserve_all": 2}
    assert prune.prune(s.table, prune.PruneOptions(exclude_predicates=("a:q",)), now).count() == 0
    assert prune.checksum(kept["preserve_all"]).first() == prune.checksum(kept["preserve_all"].repartition(3)).first()
    with pytest.raises(Q.ProfileCapabilityError):
        prune.prune(s.table, prune.PruneOptions(), now, "reference")


def test_policies(spark):
    p = spark.createDataFrame([("<r>", "<me>", "read", "allow"), ("<r>", access.EVERYBODY, "write", "allow"), ("<r>", "<me>", "write", "deny")], "resource string, subject string, mode string, effect string")
    assert [tuple(r) for r in access.acp_allowed(p, "<me>").collect()] == [("<r>", "read")]
    g = spark.createDataFrame([("<r>", access.KNOWN, "write")], "resource string, subject string, mode string")
    assert {r.mode for r in access.wac_allowed(g, "<me>").collect()} == {"write", "append"} and access.wac_allowed(g, None).isEmpty()
