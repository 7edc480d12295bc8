import datetime as dt
import random

from pyspark.sql import functions as F

from strandline.operators import cigar, output
from strandline.plans import reference
from strandline.sinks import files as sinks
from strandline.sources import files as sources
from strandline.streaming import windows


def walk(ops, start, size):
    """The pieces of a CIGAR, base by base."""
    read = ref = 0
    cut = (0, 0)
    out = []
    ops = list(ops)
    if ops and ops[0][0] in "SH":
        read = ops[0][1]
        cut = (read, 0)
        ops = ops[1:]
    for op, n in ops:
        if op in "M=X":
            read, ref = read + n, ref + n
        elif op == "I":
            if n >= size:
                out.append(("insertion", start + ref, start + ref, read, read + n))
            read += n
        elif op == "D":
            if n > size:
                if ref > cut[1]:
                    out.append(("split", start + cut[1], start + ref, cut[0], read))
                ref += n
                cut = (read, ref)
            else:
                ref += n
    if ref > cut[1]:
        out.append(("split", start + cut[1], start + ref, cut[0], read))
    return out


def test_cigar_pieces_match_a_walk(spark):
    r = random.Random(1)
    rows = []
    for i in range(200):
        ops = [(r.choice("MM=XID"), r.choice([1, 5, 39, 40, 41, 300])) for _ in range(r.randrange(1, 12))]
        ops = ([("S", 700)] if r.random() < 0.3 else []) + ops + ([("H", 5)] if r.random() < 0.3 else [])
        rows.append((i, "".join(f"{n}{o}" for o, n in ops), 1000, ops))
    df = spark.createDataFrame([x[:3] for x in rows] + [(-1, None, 5), (-2, "*", 5)], "i int, c string, s long")
    got = {x["i"]: [tuple(p)[:5] for p in x["p"]] for x in df.select("i", cigar.pieces(cigar.parse(F.col("c")), F.col("s"), 40).alias("p")).collect()}
    assert got.pop(-1) == got.pop(-2) == []
    assert got == {i: walk(ops, 1000, 40) for i, _, _, ops in rows}


def test_sam_to_segments(spark, tmp_path):
    lines = [
        "@SQ\tSN:c1\tLN:5000", "r1\t0\tc1\t101\t60\t600S1000M50D20M5I1000M\t*\t0\t0\t*\t*\tNM:i:60\tHP:i:1", "r2\t16\tc1\t1\t20\t10M60I10M\t*\t0\t0\t" + "A" * 10 + "C" * 60 + "G" * 10 + "\t*\tNM:i:60",
        "r3\t256\tc1\t1\t20\t10M\t*\t0\t0\t*\t*", "r4\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*", "short line",
    ]
    (tmp_path / "a.sam").write_text("\n".join(lines))
    path = str(tmp_path / "a.sam")
    got = {(x["read_id"], x["kind"], x["ref_start"]): x for x in cigar.segments(sources.sam(spark, path, "T01")).collect()}
    assert set(got) == {("r1", "split", 100), ("r1", "split", 1150), ("r1", "clip", 100), ("r2", "split", 0), ("r2", "insertion", 10)}
    assert got["r2", "insertion", 10]["ins_seq"] == "C" * 60 and got["r2", "split", 0]["strand"] == -1
    assert got["r1", "split", 1150]["ref_end"] == 2170 and got["r1", "split", 1150]["haplotype"] == 1 and got["r1", "split", 1150]["mismatch_rate"] == 2
    assert sources.sam_contigs(spark, path).first()["length"] == 5000


def test_short_pieces_join_the_one_before(spark):
    p = cigar.merge_short(cigar.pieces(cigar.parse(F.lit("1000M100D200M100D900M")), F.lit(0), 40))
    assert [(x["ref_start"], x["ref_end"]) for x in spark.range(1).select(p.alias("p")).first()["p"]] == [(0, 1300), (1400, 2300)]


def test_bed_panel_and_vcf(spark, tmp_path):
    (tmp_path / "a.bed").write_text("c1\t100\t200\tname\nbad line\nc2 5 9\n\nc3\t9\t5\n")
    assert sorted(map(tuple, sources.bed(spark, str(tmp_path / "a.bed")).collect())) == [("c1", 100, 200, 75, 225), ("c2", 5, 9, -20, 34)]
    assert sorted(map(tuple, sources.bed_rejects(spark, str(tmp_path / "a.bed")).collect())) == [("bad line", "columns"), ("c3\t9\t5", "order")]
    (tmp_path / "p.csv").write_text("c1,100,c1,50,1,2,INS,0.1\nc1,5,c2,9,3,4,BND,0.2\nzz,1,c1,2,0,0,DEL,0\nc1,x,c1,2,0,0,DEL,0\n")
    contigs = spark.createDataFrame([("c1", 1000, 0), ("c2", 500, 1)], "ref_id string, length long, ord int")
    got = sorted(map(tuple, sources.panel(spark, str(tmp_path / "p.csv"), contigs).collect()))
    assert got == [("c1", 5, "c2", 9, 3, 4, "BND", 0.2), ("c1", 100, "c1", 150, 1, 2, "INS", 0.1), ("c2", 9, "c1", 5, 4, 3, "BND", 0.2)]
    head = "##x\n#CHROM\n"
    (tmp_path / "a.vcf").write_text(head + "c1\t10\ta\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;END=60;P;END=99\tGT:PS\t0/1:7\t./.:.\nc1\t30\tb\tN\t<INS>\t.\tPASS\tSVTYPE=INS;SVLEN=-80\tGT:PS\t0/1:7\t0/1:.\nc2\t4\tc\tN\tx\t.\tPASS\tSVTYPE=BND;CHR2=c1;END=9\tGT\t./.\t0/1\n")
    records = sources.vcf(spark, str(tmp_path / "a.vcf"))
    assert [tuple(x) for x in sources.phase_blocks(records).collect()] == [("c1", 7, 10, 30)]
    assert sorted(map(tuple, sources.carriers(records).collect())) == [("c1", 10, "c1", 60, "DEL", 0.5), ("c1", 30, "c1", 80, "INS", 1.0), ("c2", 4, "c1", 9, "BND", 0.5)]


def test_vcf_and_tables_are_written(spark, tmp_path):
    import planted

    planted.write(tmp_path)
    contigs = spark.createDataFrame([("chr02", 500, 0), ("chr01", 1000, 1)], "ref_id string, length long, ord int")
    rows = output.vcf_table(reference._jun(spark, str(tmp_path)), ["T01", "T02", "N01", "none"])
    sinks.write_vcf(rows, contigs, str(tmp_path / "vcf"), ["T01", "T02", "N01", "none"])
    header = [x["value"] for x in spark.read.text(str(tmp_path / "vcf" / "header")).collect()]
    assert header[0] == "##fileformat=VCFv4.2" and header[-1].startswith("#CHROM\t") and "##contig=<ID=chr01,length=1000>" in header
    files = sorted((tmp_path / "vcf" / "records").glob("part-*"))
    places = [(line.split("\t")[0], int(line.split("\t")[1])) for f in files for line in f.read_text().splitlines()]
    assert len(places) == rows.count() and places == sorted(places, key=lambda p: (p[0] != "chr02", p[1]))
    assert all(len(line.split("\t")) == 13 for f in files for line in f.read_text().splitlines())
    sinks.write_table(spark.createDataFrame([(1, ["a", "b"])], "i int, x array<string>"), str(tmp_path / "t"))
    assert "1\ta,b" in "".join(f.read_text() for f in (tmp_path / "t").glob("part-*"))
    sinks.write_bed(spark.createDataFrame([("c", 5, 9), ("c", 1, 2)], "ref_id string, start_pos long, end_pos long"), str(tmp_path / "b"))
    assert "".join(f.read_text() for f in sorted((tmp_path / "b").glob("part-*"))) == "c\t1\t2\nc\t5\t9\n"


def test_stream_gives_the_same_sessions_as_a_table(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(minutes=m)) for m in (0, 3, 7, 40, 42, 200, 900)] + [("b", t0), (None, t0), ("a", None)]
    df = spark.createDataFrame(rows, "user string, at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "user", "at", "10 minutes", "1 hour")
    q = stream.writeStream.format("memory").queryName("runs").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    stored = {tuple(x) for x in windows.sessions(df, "user", "at", "10 minutes", "1 hour").collect()}
    streamed = {tuple(x) for x in spark.sql("select * from runs").collect()}
    assert len(stored) == 6 and streamed <= stored and len(streamed) >= 4
    assert windows.tumbling_counts(df, "user", "at", "1 hour", "1 hour").where("user = 'a'").count() == 3


def test_inserted_sequences(spark):
    """The part between two segments, of the primary alignment only, read backwards in a reverse one."""
    from strandline.operators import rearrangements

    rows = [("r1", False, False, False, False, "AAACCCGGG"), ("r1", False, True, False, False, "TTT"), ("r2", True, False, False, False, "AAACCCGGT"), ("r3", False, False, False, False, None)]
    alignments = spark.createDataFrame(rows, "read_id string, is_reverse boolean, is_supplementary boolean, is_secondary boolean, is_unmapped boolean, query_sequence string")
    chosen = spark.createDataFrame([("k1", "r1", 3, 6), ("k2", "r2", 0, 4), ("k3", "r3", 0, 4), ("k4", "r9", 0, 4)], "junction_key string, read_id string, read_from long, read_to long")
    assert sorted(map(tuple, rearrangements.chosen_sequences(chosen, alignments).collect())) == [("k1", "CCC"), ("k2", "CGGT")]


def test_germline_and_somatic_files(spark, tmp_path):
    import planted

    planted.write(tmp_path)
    contigs = spark.createDataFrame([("chr02", 500, 0)], "ref_id string, length long, ord int")
    sinks.write_vcf_pair(reference._jun(spark, str(tmp_path)), contigs, str(tmp_path / "pair"), ["T01", "N01"])
    count = lambda n: sources.vcf(spark, str(tmp_path / "pair" / n / "records")).count()
    assert 0 < count("somatic") < count("all")
