"""Schema of an annotated sample."""

SAMPLE_DDL = """
sample_id string, dataset string, sequence string, label double, label_type string,
label_unit string, assay_type string, assay_metadata map<string,string>,
edits array<struct<edit_id:string,edit_family:string,edit_type:string,anchor_kind:string,
anchor_positions:array<int>,anchor_residues:array<string>,chem_rep_raw:string,
chem_rep_canonical:string,attachment_semantics:string,parser_status:string,rule_id:string,
edit_metadata:map<string,string>>>,
anchor_status string,
provenance struct<source_file:string,source_row_index:bigint,parser_version:string,
parsing_date:string,raw_data_sample:map<string,string>>,
split_metadata map<string,string>, quality_flags array<string>
""".replace("\n", " ").strip()

# Columns of the flat layout, nested ones as JSON text.
FLAT_COLUMNS = (
    "sample_id",
    "dataset",
    "sequence",
    "label",
    "label_type",
    "label_unit",
    "assay_type",
    "assay_metadata_json",
    "edits_json",
    "anchor_status",
    "provenance_json",
    "split_metadata_json",
    "quality_flags_json",
)

NESTED_DDL = {
    "assay_metadata": "map<string,string>",
    "edits": SAMPLE_DDL[SAMPLE_DDL.index("edits ") + 6 : SAMPLE_DDL.index(", anchor_status")],
    "provenance": SAMPLE_DDL[
        SAMPLE_DDL.index("provenance ") + 11 : SAMPLE_DDL.index(", split_metadata")
    ],
    "split_metadata": "map<string,string>",
    "quality_flags": "array<string>",
}
