import planted
import pyarrow as pa
import pyarrow.parquet as pq

from strandline.plans import reference_calls as plans


def test_adjacencies_and_groups_join_components(spark, tmp_path):
    """An adjacency over 200 kb links two junctions, a group two on other contigs; each alone is no component with several junctions."""
    blank = dict.fromkeys(planted.JUNCTIONS) | {"genome_id": "T01", "hp1": 1, "hp2": 1, "supp": 5, "is_pass": "PASS", "is_single": False}
    rows = [
        blank | {"junction_key": "+chr01:10000|+chr02:500000", "vcf_sv_type": "BND", "gr_id": None}, blank | {"junction_key": "-chr01:210000|-chr03:900000", "vcf_sv_type": "BND", "gr_id": None},
        blank | {"junction_key": "+chr04:10000|-chr04:30000", "vcf_sv_type": "DEL", "gr_id": "g"}, blank | {"junction_key": "+chr05:10000|+chr05:80000", "vcf_sv_type": "INV", "gr_id": "g"},
    ]
    pq.write_table(pa.Table.from_pylist(rows, pa.schema(list(planted.JUNCTIONS.items()))), tmp_path / "junctions.parquet")
    keys = [sorted(x["junction_key"] for x in plans.linked_cluster_rows(spark, str(tmp_path)).collect() if x["component"].startswith(c)) for c in ("chr01", "chr04")]
    assert keys == [sorted(r["junction_key"] for r in rows[:2]), sorted(r["junction_key"] for r in rows[2:])]
    assert plans.cluster_rows(spark, str(tmp_path)).count() == 0
    assert sorted(x["n_junctions"] for x in plans.linked_component_table(spark, str(tmp_path)).collect()) == [2, 2]
