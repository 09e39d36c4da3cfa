"""Conversion, keys, validation, canonical forms, features and files on hand-made samples."""

import math

import pytest
from pyspark.sql import functions as F

from annoframe.functions import sequences as S
from annoframe.functions.tquantile import t_975
from annoframe.operators import canonical, convert, features, perturb, validate
from annoframe.sources import samples as files
from annoframe.sources import tables

RAW = [
    (1, "['L', 'meL', 'dP']", "Circle", "-5.5"),
    (2, "['Me_dA', 'Sar', 'K']", "Lariat", "-6"),
    (3, "['ac-', 'A', 'G', 'V', '-pip']", None, "-7.25"),
    (4, "['A', 'G']", "Circle", "-5"),
    (5, "['A', 'Zzz', 'G', 'V']", None, "-5"),
    (6, "['A', 'G', 'V']", None, None),
    (7, "['A', 'G', 'V']", None, "low"),
    (8, "not a list", None, "-5"),
]


@pytest.fixture(scope="module")
def converted(spark):
    raw = spark.createDataFrame(RAW, "ID int, Sequence string, Shape string, Assay string")
    return convert.convert(raw, "demo set", "ID", "Sequence", "Assay", shape="Shape").cache()


def notes(row):
    return [(e.edit_type, list(e.anchor_positions), e.anchor_kind) for e in row.edits]


def test_conversion_cases(converted):
    good = {r.provenance.source_row_index: r for r in convert.good(converted).collect()}
    assert sorted(good) == [1, 2, 3]
    assert good[1].sequence == "LLP" and good[1].sample_id == "DEMO_SET_000001"
    assert notes(good[1]) == [
        ("n_methylation", [1], "explicit"),
        ("d_amino_acid", [2], "explicit"),
        ("head_to_tail_cyclization", [0, 2], "explicit"),
    ]
    assert good[2].sequence == "AGK"
    assert notes(good[2]) == [
        ("d_amino_acid", [0], "explicit"),
        ("n_methylation", [0], "explicit"),
        ("non_standard_aa", [1], "explicit"),
        ("lariat_cyclization", [], "inferred"),
    ]
    assert good[2].anchor_status == "weakly_inferable"
    assert [n[:2] for n in notes(good[3])] == [
        ("n_acetylation", [0]),
        ("c_terminal_modification", [2]),
    ]
    assert [e.edit_id for e in good[1].edits][2] == "DEMO_SET_000001_edit_2"


def test_conversion_errors(converted):
    errors = {r.row_index: r.error for r in convert.bad(converted).collect()}
    assert errors[4] == errors[5] == errors[8] == "Failed to parse sequence"
    assert errors[6] == "Label is missing or null" and "low" in errors[7]
    report = convert.report(converted).first()
    assert (report.total_rows, report.successful, report.failed) == (8, 3, 5)


def test_relaxed_mode_skips_unknown_tokens(spark):
    raw = spark.createDataFrame([RAW[4]], "ID int, Sequence string, Shape string, Assay string")
    row = convert.convert(raw, "demo", "ID", "Sequence", "Assay", shape="Shape", strict=False).first()
    assert row.sequence == "AGV" and row.edits == []


def test_converted_samples_are_valid(converted):
    checked = validate.with_errors(convert.good(converted), validate.sample_rules())
    assert checked.filter(F.size("errors") > 0).count() == 0


def test_validation_rejects_bad_letters(converted):
    broken = convert.good(converted).withColumn("sequence", F.lit("ACDX"))
    valid, quarantine = validate.split_valid(broken, validate.sample_rules())
    assert valid.count() == 0
    assert all("sequence_alphabet" in r.errors for r in quarantine.collect())


EDIT = (
    "struct<edit_id:string,edit_family:string,edit_type:string,anchor_kind:string,"
    "anchor_positions:array<int>,anchor_residues:array<string>,chem_rep_raw:string,"
    "chem_rep_canonical:string,attachment_semantics:string,parser_status:string,rule_id:string,"
    "edit_metadata:map<string,string>>"
)


def edit(family, positions, kind="explicit", edit_type="t", residues=None, meta=None):
    letters = residues or ["A"] * len(positions)
    return ("D_1_edit_0", family, edit_type, kind, positions, letters, "r", "c", "s", "success", "v", meta or {})


def test_keys(spark):
    rows = [
        (1, "ACDEFG", []),
        (2, "ACDEFG", [edit("cyclization", [5, 0])]),
        (3, "ACDEFG", [edit("sidechain", [1])]),
        (4, "ACDEFG", [edit("sidechain", [1]), edit("cyclization", [])]),
    ]
    df = spark.createDataFrame(rows, f"id int, sequence string, edits array<{EDIT}>")
    got = {
        r.id: (r.s, r.p)
        for r in df.select(
            "id",
            S.scaffold_key(F.col("sequence"), F.col("edits")).alias("s"),
            S.profile_key(F.col("edits")).alias("p"),
        ).collect()
    }
    assert got[1] == ("ACDEFG", "no_edits")
    assert got[2] == ("ACDEFG_cyc_0_5", "cyclization")
    assert got[3] == ("ACDEFG", "sidechain")
    assert got[4] == ("ACDEFG_cyc_", "cyclization+sidechain")


def test_block_widths():
    widths = {
        "chemistry_only": 10,
        "site_only": 35,
        "context_only": 28,
        "chemistry_anchors": 45,
        "chemistry_attachment": 38,
        "site_context_only": 63,
        "full": 73,
    }
    assert {k: len(features.feature_names(k)) for k in widths} == widths


def test_features_by_hand(spark):
    edits = [
        edit("n_terminal", [0], edit_type="acetylation", residues=["A"]),
        edit("sidechain", [0, 4], edit_type="x", residues=["A", "F"]),
        edit("other", [], "global"),
        edit("cyclization", [0, 5], edit_type="x", residues=["A", "G"], meta={"ring_size": "6"}),
    ]
    df = spark.createDataFrame([(1, "ACDEFG", edits)], f"id int, sequence string, edits array<{EDIT}>")
    row = features.select_blocks(df, "site_context_only", ["id"]).first().asDict()
    assert list(row)[1:] == features.feature_names("site_context_only")
    assert row["anchor_count_total"] == 5 and row["anchor_count_unique"] == 3
    assert row["anchor_pos_mean"] == pytest.approx(9 / 5)
    assert row["anchor_pos_range"] == 5 and row["anchor_density"] == 0.5
    assert row["anchor_res_A"] == pytest.approx(3 / 5)
    assert row["anchor_aromatic_frac"] == pytest.approx(1 / 5)
    assert row["anchor_terminal_frac"] == 0.25 and row["anchor_n_terminal_count"] == 1
    assert row["edit_type_entropy"] == pytest.approx(1.5) and row["edit_type_count_unique"] == 3
    assert row["cyclization_ring_size"] == 6 and row["edit_anchor_overlap"] == 1
    assert row["anchor_pair_count"] == 2 and row["modification_rate"] == pytest.approx(4 / 6)
    assert row["edit_type_acetylation"] == 1 and row["edit_type_other"] == 3


def test_canonical_rules(spark):
    rows = [
        (1, "ACDECG", edit("cyclization", [4, 1], edit_type="disulfide_bridge")),
        (2, "ACDEKG", edit("sidechain", [4], edit_type="acetylation")),
        (3, "ACDESG", edit("sidechain", [4], edit_type="phosphorylation")),
        (4, "ACDESG", edit("substitution", [0], edit_type="d_amino_acid")),
        (5, "ACDESG", edit("sidechain", [0], edit_type="acetylation")),
        (6, "ACDESG", edit("backbone", [0], edit_type="d_amino_acid")),
    ]
    df = spark.createDataFrame(rows, f"id int, sequence string, e {EDIT}")
    got = {r.id: r for r in canonical.canonicalise(df, "sequence", "e").collect()}
    assert got[1].tagged == "disulfide@C1.SG.single-C4.SG.single:[--A-C-DEC]~[CDE-C-G--]"
    assert got[2].tagged == "Ac@K4.NZ.single:[CDE-K-G--]"
    assert got[3].tagged == "PO3@S4.OG.single:[CDE-S-G--]"
    assert got[4].moiety_name == "dA"
    assert got[5].canonical_error == "Acetylation not supported for A at position 0"
    assert got[6].canonical_note == "unsupported_modification"


def test_perturbations_stay_inside(spark):
    df = spark.range(200).select(
        "id", (F.col("id") % 9).cast("int").alias("p"), F.lit(9).alias("n")
    )
    rows = df.select(
        "p",
        perturb.wrong_anchor(F.col("p"), F.col("n"), F.col("id")).alias("w"),
        perturb.tertile(F.col("p"), F.col("n")).alias("t"),
        perturb.noise(F.col("p"), F.col("n"), F.col("id")).alias("z"),
        perturb.shift(F.col("p"), F.col("n"), 20).alias("s"),
    ).collect()
    assert all(0 <= r.w < 9 and r.w != r.p and abs(r.w - r.p) <= 5 for r in rows)
    assert all(r.t == 1 + 3 * (r.p // 3) and abs(r.z - r.p) <= 3 and r.s == 8 for r in rows)
    one = spark.range(1).select(perturb.wrong_anchor(F.lit(0), F.lit(1), F.col("id")).alias("w"))
    assert one.first().w == 0


def test_files_round_trip(spark, converted, tmp_path):
    good = convert.good(converted).withColumn(
        "provenance", F.col("provenance").withField("parsing_date", F.lit("x"))
    )
    files.write_samples_json(good, f"{tmp_path}/s.jsonl")
    files.write_samples_parquet(good, f"{tmp_path}/s.parquet")
    flat = spark.read.parquet(f"{tmp_path}/s.parquet")
    assert len(flat.columns) == 13 and flat.first().split_metadata_json == "null"
    for path in ("s.jsonl", "s.parquet"):
        back = files.read_samples(spark, f"{tmp_path}/{path}")
        assert sorted((r.sample_id, len(r.edits), r.label) for r in back.collect()) == sorted(
            (r.sample_id, len(r.edits), r.label) for r in good.collect()
        )
    with pytest.raises(ValueError):
        files.read_samples(spark, f"{tmp_path}/s.xml")


def test_both_formats_are_whole_and_small(spark, converted, tmp_path):
    good = convert.good(converted)
    assert files.write_both(good, str(tmp_path), "s") == {"jsonl": good.count(), "parquet": good.count()}
    files.write_samples_json(good, f"{tmp_path}/plain.jsonl", compression="none")
    lines = lambda name: sorted(r.value for r in spark.read.text(f"{tmp_path}/{name}.jsonl").collect())
    assert lines("s") == lines("plain")
    assert all(p.suffix == ".gz" for p in (tmp_path / "s.jsonl").glob("part-*"))


def test_bad_json_lines_are_kept(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"sample_id": "A_1", "label": 1.0}\n\n{broken\n')
    good, bad = files.readable(files.read_samples_json(spark, f"{tmp_path}/x.jsonl").cache())
    assert [r.sample_id for r in good.collect()] == ["A_1"] and bad.count() == 1


def test_checksums(spark, tmp_path):
    import hashlib

    (tmp_path / "a.csv").write_bytes(b"hello")
    row = tables.checksum_manifest(spark, str(tmp_path), "*.csv").first()
    assert row.sha256 == hashlib.sha256(b"hello").hexdigest() and row.length == 5


def test_t_quantiles():
    known = {1: 12.706204736, 4: 2.776445105, 9: 2.262157163, 30: 2.042272456}
    assert all(math.isclose(t_975(k), v, rel_tol=1e-9) for k, v in known.items())


def test_labels_must_be_written_as_numbers(spark):
    texts = ["1", "-2.5", "1e3", ".5", "1_000", "1d", "5f", "0x1", "", " 7 ", "abc", None]
    want = [1.0, -2.5, 1000.0, 0.5, 1000.0, None, None, None, None, 7.0, None, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(convert.label(df.t)).collect()] == want


def test_token_list_with_escapes(spark):
    from annoframe.operators import convert

    cases = [r"['L', 'it\'s']", r'["a\"b", "c\\n", "d\ne"]', r"['x\d']", r"['a\\']", "['L'", "[]"]
    df = spark.createDataFrame([(c,) for c in cases], "t string").withColumn("got", convert.parse_token_list(F.col("t")))
    import ast

    for r in df.collect():
        want = None if r.t == "['L'" else ast.literal_eval(r.t)
        assert r.got == want
