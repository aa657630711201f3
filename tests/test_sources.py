import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from spandrel.sources import catalogs, compressed, tables, vcf
from spandrel.streaming import files

VCF = "\n".join(
    [
        "##fileformat=VCFv4.2", '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="kind, of variant">', "##contig=<ID=chr1,length=248956422>", '##FORMAT=<ID=GT,Number=1,Type=String,Description="g">',
        "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2", "chr1\t10\tv1\tA\tACAGCAGCAG\t.\tPASS\tSVTYPE=INS;PRECISE\tGT:DR\t0/1:3\t./.:.", "chr1\t20\tv2\tA\t<INS>\t.\tq\tSVTYPE=INS\tGT\t1|1\t0/0", "short\tline",
    ]
)


def test_catalogue_formats(spark, tmp_path):
    (tmp_path / "a.bed").write_text("chr1\t5\t9\tcag\textra\n1\tx\t9\tA\nMT\t1\t2\tAT\n")
    (tmp_path / "t.bed").write_text("#c\nchr2\t1\t9\tID=x;MOTIFS=CAG,CTG;STRUC=y\n")
    row = "585\tchr1\t10\t20\ttrf\t3\t3.333\t3\t95\t1\t40\t0\t0\t0\t0\t1.2\tCAG\n"
    (tmp_path / "s.txt").write_bytes(gzip.compress(row.encode()))
    bed, trgt, simple = (catalogs.read_catalog(spark, str(tmp_path / n)) for n in ("a.bed", "t.bed", "s.txt"))
    assert sorted(tuple(r) for r in bed.collect()) == [("chr1", 5, 9, "CAG"), ("chrM", 1, 2, "AT")]
    assert sorted(r.motif for r in trgt.collect()) == ["CAG", "CTG"]
    one = simple.first()
    assert (one.start, one.motif, one.period, one.copy_num, one.per_match) == (10, "CAG", 3, 3.33, 95)


def test_vcf(spark, tmp_path):
    p = tmp_path / "x.vcf"
    p.write_text(VCF)
    h = vcf.read_header(spark, str(p))
    assert h.samples == ["s1", "s2"] and h.info["SVTYPE"]["Description"] == "kind, of variant" and vcf.assembly(h) == "GRCh38"
    rec = vcf.records(spark, str(p))
    assert rec.count() == 2
    assert [r.sequence for r in vcf.insertions(rec, 3).collect()] == ["CAGCAGCAG", "<INS>"]
    assert {r["sample"]: r.n_insertions_raw for r in vcf.raw_insertions_per_sample(rec, h.samples).collect()} == {"s1": 2, "s2": 0}
    assert {(r.kind, r.value): r.n for r in vcf.counters(rec).collect()}[("alt", "symbolic")] == 1
    dup = vcf.svtype_as_dup(rec).orderBy("POS").collect()
    assert dup[1].ALT == "<DUP>" and "ORIG_SVTYPE=INS" in dup[0].INFO
    assert vcf.as_lines(rec).orderBy("value").first()["value"].startswith("chr1\t10\tv1\tA\tACAG")
    prof = {r.field: r for r in vcf.field_profile(vcf.long_form(rec, h.samples)).collect()}
    assert prof["GT"].seen == 4 and prof["GT"].missing == 1


def test_resolved_alleles_and_lps(spark):
    df = spark.createDataFrame([("0/1", "A", "ACAGCAGCAG,AT"), ("2|.", "A", "ACAG,AT")], ["gt", "ref", "alts"])
    hap = vcf.haplotypes(F.col("gt"))
    out = df.select(*[vcf.resolved_allele(F.get(hap, F.lit(k)), F.col("ref"), F.col("alts")).alias(f"a{k}") for k in (0, 1)])
    assert [tuple(r) for r in out.collect()] == [("A", "ACAGCAGCAG"), ("AT", None)]
    assert vcf.longest_pure_segments(out, ("a0", "a1")).first().lps == 9


def test_tables_and_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.tsv").write_text("chrom\tn\nchr1\t5\nNA\t.\n")
    df = tables.tsv_to_parquet(spark, str(src / "a.tsv"), str(tmp_path / "a.parquet"))
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("chr1", "5"), (None, None)], key=str) or df.count() == 2
    args = (str(src), str(tmp_path / "out"), str(tmp_path / "cp"), ["chrom", "n"])
    assert files.convert_new_files(spark, *args) == 2
    (src / "b.tsv").write_text("chrom\tn\nchr2\t6\n")
    assert files.convert_new_files(spark, *args) == 1
    assert spark.read.parquet(args[1]).count() == 3
    calls = tmp_path / "calls.tsv"
    calls.write_text("chrom\tins_coord\tSVID\tsample\tmotif\trep_start\trep_end\nchr1\t5\ta\ts\tCAG\t0\t9\nchr1\tbad\ta\ts\tCAG\t0\t9\n")
    good, bad = tables.read_calls(spark, str(calls))
    assert good.count() == 1 and bad.first().n_bad == 1
    sites = good.unionByName(good)
    assert [tuple(r) for r in tables.bed_of_sites(sites, "chrom", "ins_coord").collect()] == [("chr1", 4, 5)]
    assert tables.bed_first_wins(sites, "SVID", "chrom", "ins_coord", "rep_start").first().end == 6


def bgzf(data: bytes, size: int) -> bytes:
    out = b""
    for k in (*range(0, len(data), size), None):
        part = b"" if k is None else data[k : k + size]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = c.compress(part) + c.flush()
        out += bytes.fromhex("1f8b08040000000000ff0600424302 00".replace(" ", "")) + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(part), len(part))
    return out


@pytest.mark.parametrize("name", ["a.vcf.gz", "a.txt"])
@pytest.mark.parametrize(("size", "split"), [(60_000, 1 << 27), (500, 4000), (37, 700)])
def test_bgzf_is_read_in_ranges(spark, tmp_path, monkeypatch, name, size, split):
    r = random.Random(5)
    texts = [f"{k}\t" + "".join(r.choice("ACGT\u00e9") for _ in range(r.choice([0, 3, 40, 400]))) for k in range(400)] + ["x" * 9000, "last"]
    (tmp_path / name).write_bytes(bgzf("\r\n".join(texts).encode(), size))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        read = compressed.lines(spark, str(tmp_path / name))
        assert sorted(x.value for x in read.collect()) == sorted(texts)
        n = compressed._blocks(spark, [str(tmp_path / name)]).rdd.getNumPartitions()
        assert n > 3 if split < 1 << 20 else n >= 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_packed_kinds_and_first_bytes(spark, tmp_path):
    (tmp_path / "plain").write_bytes(b"a\nb\n")
    (tmp_path / "packed").write_bytes(gzip.compress(b"c\n") + gzip.compress(b"d\ne"))
    (tmp_path / "blocks").write_bytes(bgzf(b"f\n", 100))
    (tmp_path / "empty").write_bytes(b"")
    kinds = {n: compressed.kind(spark, str(tmp_path / n)) for n in ("plain", "packed", "blocks", "empty")}
    assert kinds == {"plain": "plain", "packed": "gzip", "blocks": "bgzf", "empty": "plain"}
    assert compressed.first_bytes(spark, str(tmp_path / "plain"), 2) == b"a\n"
    assert [sorted(x.value for x in compressed.lines(spark, str(tmp_path / n)).collect()) for n in ("plain", "packed", "blocks", "empty")] == [["a", "b"], ["c", "d", "e"], ["f"], []]
    (tmp_path / "damaged").write_bytes(bgzf(b"f\n" * 50, 100)[:-40] + b"xx")
    with pytest.raises(Exception, match="block"):
        compressed.lines(spark, str(tmp_path / "damaged")).collect()


def test_records_and_samples_read_side_by_side(spark):
    rows = [("chr1", 10, "v1", "A", "ACC", "s1", "1|1", "ACC", "chr1_10-chr1_12"), ("chr1", 10, "v1", "A", "ACC", "s2", "0/1", "ACCC", "chr1_14-chr1_15"), ("chr1", 10, "v1", "A", "ACC", "s3", "0/0", "TTT", "chr1_99-chr1_99")]
    rows += [("chr2", k, f"v{k}", "G", "<INS>", "s1", "0/1", "TAC", f"chr2_{k}-chr2_{k}") for k in range(20, 29)] + [("chr2", 40, "v40", "G", "N[chr1:5[", "s1", "0/1", None, None)]
    long = spark.createDataFrame(rows, "CHROM string, POS long, ID string, REF string, ALT string, sample string, gt string, own string, co string")
    long = long.withColumn("fields", F.create_map(F.lit("GT"), "gt", F.lit("AL"), "own", F.lit("CO"), "co"))
    out = {(x.kind, x.alt): x for x in vcf.readings(long, {"genotype": "GT", "sequence": "AL", "coordinate": "CO"}, examples=2).collect()}
    n = {k: (x.n_records, x.n_samples) for k, x in out.items()}
    assert n == {("compared", "literal"): (1, 2), ("several_alleles", "literal"): (1, 2), ("shifted", "literal"): (1, 2), ("compared", "symbolic"): (9, 9), ("no_sample_has_alt", "symbolic"): (9, 9), ("anchor_differs", "symbolic"): (9, 9)}
    shown = out["anchor_differs", "symbolic"].examples
    assert [x.POS for x in shown] == [20, 21] and [tuple(s) for s in shown[0].samples] == [("s1", "TAC", 0)]
