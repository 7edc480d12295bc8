"""Small tables in which every relation between segments, junctions and panel records occurs: few contigs, short axes, many near neighbours."""

import datetime as dt
import random

import pyarrow as pa
import pyarrow.parquet as pq

I64, I32, S, B, D = pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.float64()
SEGMENTS = {
    "genome_id": S, "read_id": S, "seg_id": I64, "align_start": I64, "read_start": I64, "read_end": I64, "ref_id": S, "ref_start": I64, "ref_end": I64, "ref_start_ori": I64, "ref_end_ori": I64,
    "strand": I32, "read_length": I64, "align_len": I64, "segment_length": I64, "haplotype": I32, "mapq": I32, "mismatch_rate": I32, "error_rate": I32, "is_pass": S, "is_insertion": B, "is_clipped": B,
    "is_primary": B, "ins_seq": S, "aln_key": S, "loaded_at": pa.timestamp("us"),
}
JUNCTIONS = {
    "junction_key": S, "bp1_id": I64, "bp2_id": I64, "genome_id": S, "hp1": I32, "hp2": I32, "supp": I64, "supp_read_ids": pa.list_(S), "length": I64, "is_pass": S, "prec": I32, "is_dup": B, "sv_type": S,
    "vcf_sv_type": S, "vcf_id": S, "dr": I64, "dv": I64, "vaf": D, "hvaf": D, "vcf_qual": D, "phaseset1": I64, "phaseset2": I64, "cluster_id": S, "vaf_pass": S, "mut_type": S, "genotype": S,
    "gr_id": S, "tra_pos": S, "inv_bounds": pa.list_(I64), "vntr": pa.struct([("vntr_start", I64), ("vntr_end", I64)]), "is_single": B,
}
PANEL = {"panel_id": I64, "chrom": S, "pos": I64, "chr2": S, "stop_pos": I64, "svtype": S, "svlen": I64, "cipos": pa.list_(I32), "ciend": pa.list_(I32), "carriers": I32}
PAF = {"aln_id": I64, "qry_id": S, "loaded_at": pa.timestamp("us"), "qry_start": I64, "qry_end": I64, "ref_id": S, "ref_start": I64, "ref_end": I64, "mapq": I32, "type_tag": S}


def maybe(r, value, p=0.05):
    return None if r.random() < p else value


def segments(r, n=500):
    rows = []
    base = "".join(r.choice("ACGT") for _ in range(400))
    for i in range(n):
        kind = r.choice(["split"] * 6 + ["ins", "ins", "clip"])
        start = r.randrange(0, 12) * 4000 + r.randrange(0, 120)
        size = r.choice([0, 60, 300, 300, 5000, 9000]) if kind == "split" else r.choice([60, 100, 110, 400])
        at = r.randrange(0, 200)
        rows.append({
            "genome_id": r.choice(["T01", "T01", "T01", "T02", "N01"]), "read_id": maybe(r, f"r{r.randrange(n // 4)}", 0.02), "seg_id": i, "align_start": r.randrange(0, 3) * 100, "read_start": (s := r.randrange(0, 20) * 400),
            "read_end": s + r.choice([300, 900, 1500]), "ref_id": maybe(r, r.choice(["chr01", "chr02"])), "ref_start": start, "ref_end": start + (size if kind == "split" else 0), "ref_start_ori": start, "ref_end_ori": start + r.randrange(3),
            "strand": r.choice([1, -1]), "read_length": maybe(r, r.choice([0, 5000, 9000, 12000])), "align_len": size, "segment_length": maybe(r, max(size, 60)), "haplotype": maybe(r, r.randrange(3)), "mapq": maybe(r, r.choice([0, 30, 60, 60])),
            "mismatch_rate": maybe(r, r.choice([1, 2, 3, 40, 60])), "error_rate": maybe(r, r.randrange(40)), "is_pass": maybe(r, r.choice(["PASS"] * 4 + ["_LOW_MAPQ"])), "is_insertion": kind == "ins", "is_clipped": kind == "clip",
            "is_primary": maybe(r, r.random() < 0.7), "ins_seq": base[at : at + r.choice([4, 60, 100, 150])] if kind == "ins" else None, "aln_key": str(i), "loaded_at": dt.datetime(2024, 1, 1 + i % 20),
        })
    place = {"genome_id": "T01", "is_insertion": False, "is_clipped": False, "is_pass": "PASS", "mapq": 60, "ref_id": "chr01", "ref_start": 100_100, "ref_end": 100_400, "ins_seq": None}
    rows += [rows[0] | place | {"seg_id": n + k, "read_id": f"m{k}", "mismatch_rate": 90 if k < 6 else 2} for k in range(11)]
    rows.append(rows[0] | place | {"seg_id": n + 40, "read_id": "m40", "ref_start": 99_990, "ref_end": 101_000, "segment_length": 1010, "mismatch_rate": 2})
    rows += [rows[0] | place | {"seg_id": n + 50 + 3 * g + h, "read_id": f"i{g}{h}", "genome_id": ["T01", "T02", "N01"][g], "haplotype": h, "is_insertion": True, "ref_start": 400_000, "ref_end": 400_000, "segment_length": 400, "ins_seq": "ACGT" * 100} for g in range(3) for h in range(3)]
    alone = place | {"ref_id": "chr02", "ref_start": 200_000, "ref_end": 206_500, "haplotype": 1, "mismatch_rate": 1}
    rows += [rows[0] | alone | {"seg_id": n + 20 + k, "read_id": f"h{k}"} for k in range(5)]
    return rows + [row | {"loaded_at": row["loaded_at"] + dt.timedelta(days=40)} for row in r.sample(rows, 20)]


def junctions(r, n=400):
    rows = []
    for i in range(n):
        what = r.choice(["DEL", "DUP", "INV", "INV", "BND", "BND", "INS", "INS"])
        a = r.randrange(0, 12) * 4000 + r.randrange(0, 150)
        size = r.choice([80, 100, 120, 3000, 3020, 15000])
        b = a + size
        ca, cb = r.choice([("chr01", "chr02"), ("chr01", "chr02"), ("chr02", "chr01")]) if what == "BND" else (c := r.choice(["chr01", "chr02"]), c)
        s, t = {"DEL": "+-", "DUP": "-+", "INV": r.choice(["++", "--"]), "BND": r.choice(["++", "--", "+-", "-+"]), "INS": "  "}[what]
        key = f"{ca}:{a}|INS:{size}" if what == "INS" else f"{s}{ca}:{a}|{t}{cb}:{b}"
        rows.append({
            "junction_key": maybe(r, key, 0.02), "bp1_id": i, "bp2_id": i, "genome_id": maybe(r, r.choice(["T01", "T02", "N01"]), 0.02), "hp1": maybe(r, r.randrange(3)), "hp2": maybe(r, r.randrange(3)), "supp": maybe(r, r.choice([0, 1, 3, 5, 30])),
            "supp_read_ids": maybe(r, [f"r{r.randrange(9)}" for _ in range(r.randrange(4))]), "length": maybe(r, size), "is_pass": r.choice(["PASS"] * 5 + ["FAIL", "FAIL_MERGED_HP"]), "prec": maybe(r, r.randrange(2)), "is_dup": what == "DUP",
            "sv_type": maybe(r, "tandem_duplication" if what == "DUP" else what), "vcf_sv_type": maybe(r, what), "vcf_id": maybe(r, f"sv{i}"), "dr": maybe(r, r.randrange(20)), "dv": 1, "vaf": r.choice([0.2, 0.4]), "hvaf": maybe(r, 0.25, 0.5), "vcf_qual": maybe(r, r.choice([55.5, 20.0])), "vaf_pass": r.choice(["PASS", "PASS", "FAIL"]), "mut_type": maybe(r, r.choice(["somatic", "germline"])), "genotype": maybe(r, r.choice(["het", "hom"])),
            "phaseset1": maybe(r, max(0, a - r.randrange(5000)), 0.4), "phaseset2": None, "cluster_id": maybe(r, "c", 0.5), "vntr": maybe(r, {"vntr_start": a // 4000 * 4000, "vntr_end": a // 4000 * 4000 + 160}, 0.3), "is_single": r.random() < 0.05, "gr_id": maybe(r, f"g{r.randrange(40)}", 0.7), "tra_pos": maybe(r, "chr01:5-9", 0.9), "inv_bounds": [a, b] if what == "INV" and r.random() < 0.7 else None,
        })
    own = {(x["junction_key"], x["genome_id"], x["hp1"], x["hp2"]): x for x in rows}
    twin = next(x for x in own.values() if x["junction_key"] and x["vcf_sv_type"] == "DEL") | {"genome_id": "T01", "hp1": 1, "hp2": 1, "supp": 5}
    twins = [twin | {"junction_key": f"+chr01:777|-chr01:{b}"} for b in (900, 950)]
    return [*own.values(), *list(own.values())[:15], *twins, *[x | {"supp": (x["supp"] or 0) + 7, "vcf_id": "more"} for x in list(own.values())[20:35]]]


def panel(r, n=150):
    spell = lambda c: r.choice([c, c.upper(), " " + c, c[4:], "Chr0" + c[4:]])
    rows = []
    for i in range(n):
        c, c2 = r.choice(["chr01", "chr02"]), r.choice(["chr01", "chr02"])
        a = r.randrange(0, 12) * 4000 + r.randrange(0, 150)
        rows.append({"panel_id": i, "chrom": spell(c), "pos": a, "chr2": maybe(r, spell(c2), 0.4), "stop_pos": maybe(r, a + r.choice([0, 80, 100, 3000])), "svtype": maybe(r, r.choice(["DEL", "ins", "BND"])), "svlen": maybe(r, r.choice([-80, 100])), "cipos": maybe(r, [-5, 20]), "ciend": [-5, 5], "carriers": maybe(r, 7)})
    return rows


def paf(r, n=300):
    rows = [
        {"aln_id": i, "loaded_at": dt.datetime(2024, 1, 1), "qry_id": maybe(r, f"q{r.randrange(60)}"), "qry_start": 0, "qry_end": r.choice([40, 500]), "ref_id": maybe(r, r.choice(["chr01", "NC_1", "K7"])), "ref_start": maybe(r, (s := r.randrange(0, 900))), "ref_end": maybe(r, s + r.choice([100, 130])), "mapq": maybe(r, r.choice([0, 10, 60])), "type_tag": maybe(r, r.choice(["tp:A:P", "tp:A:S"]))}
        for i in range(n)
    ]
    return rows + rows[:10] + [x | {"loaded_at": dt.datetime(2024, 2, 1), "qry_end": 900} for x in rows[10:20]]


def contigs(r):
    return [{"ref_id": "chr01", "length": 3_000_000, "ord": 0}, {"ref_id": "chr02", "length": 50_000, "ord": 1}]


CONTIGS = {"ref_id": S, "length": I64, "ord": I32}
TABLES = {"contigs": (contigs, CONTIGS), "segments": (segments, SEGMENTS), "junctions": (junctions, JUNCTIONS), "panel_records": (panel, PANEL), "paf": (paf, PAF)}


def write(folder, seed=1, empty=False):
    r = random.Random(seed)
    for name, (make, kinds) in TABLES.items():
        table = pa.Table.from_pylist([] if empty else make(r), pa.schema(list(kinds.items())))
        pq.write_table(table, f"{folder}/{name}.parquet")
