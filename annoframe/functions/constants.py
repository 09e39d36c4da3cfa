"""Fixed values of the data model: vocabularies, letter properties, lookup tables, thresholds."""

# Alphabet and limits of a sequence.
LETTERS = "ACDEFGHIKLMNPQRSTVWY"
MIN_LENGTH = 3
MAX_LENGTH = 100

# Vocabularies of a sample and its annotations.
FAMILIES = (
    "n_terminal",
    "c_terminal",
    "sidechain",
    "backbone",
    "cyclization",
    "substitution",
    "other",
)
ANCHOR_KINDS = ("explicit", "inferred", "ambiguous", "global")
PARSER_STATUSES = ("success", "inferred", "partial", "failed")
ANCHOR_STATUSES = ("explicit_anchor", "weakly_inferable", "not_resolvable", "no_edits")
EXCLUSION_REASONS = (
    "missing_sequence",
    "unparseable_sequence",
    "missing_label",
    "non_numeric_label",
    "missing_modification",
    "ambiguous_modification",
    "no_anchor_resolvable",
    "weak_anchor_only",
    "multi_edit",
    "duplicate",
    "wrong_assay_type",
    "missing_metadata",
    "invalid_format",
    "other",
)
PROVENANCE_KEYS = ("source_file", "source_row_index", "parser_version")
SAMPLE_ID_PATTERN = "^[A-Z_]+_[0-9]+$"
EDIT_ID_PATTERN = "^[A-Z_]+_[0-9]+_edit_[0-9]+$"

# Substrings that make an annotation text ambiguous.
AMBIGUOUS_MARKERS = (
    "unknown",
    "unclear",
    "multiple",
    "various",
    "unspecified",
    "?",
    "tbd",
    "see notes",
)

# Letter groups of the composition block (overlapping).
PROPERTY_GROUPS = {
    "hydrophobic": "AILMFVPW",
    "polar": "NQST",
    "positive": "KRH",
    "negative": "DE",
    "aromatic": "FYW",
    "small": "AGSV",
    "tiny": "AGS",
    "aliphatic": "ILV",
}

# Letter groups of the anchor-residue block.
ANCHOR_GROUPS = {
    "hydrophobic": "ILVAFWM",
    "charged": "DEKRH",
    "polar": "STNQYC",
    "aromatic": "FYW",
    "small": "GAS",
    "proline": "P",
}

# Approximate residue mass.
MASS = {
    "A": 89, "C": 121, "D": 133, "E": 147, "F": 165,
    "G": 75, "H": 155, "I": 131, "K": 146, "L": 131,
    "M": 149, "N": 132, "P": 115, "Q": 146, "R": 174,
    "S": 105, "T": 119, "V": 117, "W": 204, "Y": 181,
}

# Hydropathy index.
HYDROPATHY = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8,
    "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8,
    "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5,
    "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}

# Charge and size class used by window features (letters not listed are 0).
WINDOW_CHARGE = {"R": 1.0, "D": -1.0, "E": -1.0, "H": 0.5, "K": 1.0}
WINDOW_LARGE = "RILFWY"

# Annotation types with a count feature of their own.
COUNTED_TYPES = (
    "n_methylation",
    "d_amino_acid",
    "non_standard_aa",
    "head_to_tail_cyclization",
    "sidechain_cyclization",
    "disulfide",
    "acetylation",
    "amidation",
    "phosphorylation",
)

# External descriptor names of block A and of the extended set.
DESCRIPTORS = (
    "mol_weight",
    "logp",
    "tpsa",
    "num_h_acceptors",
    "num_h_donors",
    "num_rotatable_bonds",
    "num_aromatic_rings",
    "num_aliphatic_rings",
)

# Atoms a residue can be attached at.
RESIDUE_ATOMS = {
    "A": ["CA", "CB"],
    "C": ["CA", "CB", "SG"],
    "D": ["CA", "CB", "CG", "OD1", "OD2"],
    "E": ["CA", "CB", "CG", "CD", "OE1", "OE2"],
    "F": ["CA", "CB", "CG", "CD1", "CD2", "CE1", "CE2", "CZ"],
    "G": ["CA"],
    "H": ["CA", "CB", "CG", "ND1", "CD2", "CE1", "NE2"],
    "I": ["CA", "CB", "CG1", "CG2", "CD1"],
    "K": ["CA", "CB", "CG", "CD", "CE", "NZ"],
    "L": ["CA", "CB", "CG", "CD1", "CD2"],
    "M": ["CA", "CB", "CG", "SD", "CE"],
    "N": ["CA", "CB", "CG", "OD1", "ND2"],
    "P": ["CA", "CB", "CG", "CD"],
    "Q": ["CA", "CB", "CG", "CD", "OE1", "NE2"],
    "R": ["CA", "CB", "CG", "CD", "NE", "CZ", "NH1", "NH2"],
    "S": ["CA", "CB", "OG"],
    "T": ["CA", "CB", "OG1", "CG2"],
    "V": ["CA", "CB", "CG1", "CG2"],
    "W": ["CA", "CB", "CG", "CD1", "CD2", "NE1", "CE2", "CE3", "CZ2", "CZ3", "CH2"],
    "Y": ["CA", "CB", "CG", "CD1", "CD2", "CE1", "CE2", "CZ", "OH"],
}

# Structure string of the mirrored residue.
MIRRORED_STRUCTURES = {
    "A": "C[C@H](N)C(=O)O",
    "C": "C(C[C@H](C(=O)O)N)S",
    "D": "C([C@H](C(=O)O)N)C(=O)O",
    "E": "C(CC(=O)O)[C@H](C(=O)O)N",
    "F": "C1=CC=C(C=C1)C[C@H](C(=O)O)N",
    "G": "C(C(=O)O)N",
    "H": "C1=C(NC=N1)C[C@H](C(=O)O)N",
    "I": "CC[C@@H](C)[C@H](C(=O)O)N",
    "K": "C(CCN)C[C@H](C(=O)O)N",
    "L": "CC(C)C[C@H](C(=O)O)N",
    "M": "CSCC[C@H](C(=O)O)N",
    "N": "C([C@H](C(=O)O)N)C(=O)N",
    "P": "C1C[C@H](NC1)C(=O)O",
    "Q": "C(CC(=O)N)[C@H](C(=O)O)N",
    "R": "C(C[C@H](C(=O)O)N)CNC(=N)N",
    "S": "C([C@H](C(=O)O)N)O",
    "T": "C[C@H]([C@H](C(=O)O)N)O",
    "V": "CC(C)[C@H](C(=O)O)N",
    "W": "C1=CC=C2C(=C1)C(=CN2)C[C@H](C(=O)O)N",
    "Y": "C1=CC(=CC=C1C[C@H](C(=O)O)N)O",
}

# Residues that take a phosphate and the atom it is attached at.
PHOSPHATE_ATOMS = {"S": "OG", "T": "OG1", "Y": "OH"}

# Tokens that are skipped although they are neither mapped nor terminal groups.
SKIPPED_TOKENS = ("glyco-", "deca-", "medl-")

# Base letter of the tokens that do not follow the prefix rule
# (a bare letter, or a letter after ``me``, ``d`` or ``Me_d``).
TOKEN_LETTERS = {
    "Abu": "A", "Sar": "G", "Nle": "L", "Nva": "V", "Orn": "K", "Cha": "F",
    "Hph": "F", "bHph": "F", "Nal": "F", "1-Nal": "F", "d1-Nal": "F", "Phg": "F",
    "Phe(4-F)": "F", "Phe(4-CF3)": "F", "Phe(4-NO2)": "F", "dPhe(4-F)": "F",
    "dPhe(3,4-diF)": "F", "Et_Phe": "F", "H2NEt_Phe": "F", "Me_Phe(3-Cl)": "F",
    "Phe(O->S)": "F", "Tyr(Me)": "Y", "Tyr(3-F)": "Y", "Tyr(O->S)": "Y",
    "Me_Tyr(Me)": "Y", "dTyr(bR-OMe)": "Y", "Trp(5-Br)": "W", "Trp(6-Br)": "W",
    "Trp(7-Br)": "W", "dTrp(O->S)": "W", "Ser(tBu)": "S", "Ser(Me)": "S",
    "Ser(Ac)": "S", "dSer(Me)": "S", "Thr(O->S)": "T", "Ile(O->S)": "I",
    "xiIle": "I", "d(N->O)aIle": "I", "Leu(O->S)": "L", "dLeu(3R-OH)": "L",
    "dLeu(O->S)": "L", "aMeLeu": "L", "d(N->O)Leu": "L", "(N->O)Leu": "L",
    "Val(O->S)": "V", "d(N->O)Val": "V", "(N->O)Val": "V", "(N->O)Val(3-OH)": "V",
    "Lys(Ac)": "K", "Lys(Me2)": "K", "Lys(Tfa)": "K", "Lys(O->S)": "K",
    "Arg(Me,Me)": "R", "Asp(OMe)": "D", "Asp(Ph(2-NH2))": "D",
    "dAsp(pyrrol-1-yl)": "D", "Glu(3R-Me)": "E", "Glu(OMe)": "E", "dGlu(OMe)": "E",
    "Gln(Me)": "Q", "Gln(Me2)": "Q", "dGln(Me2)": "Q", "Asn(Me2)": "N",
    "dAsn(Me2)": "N", "Met(O2)": "M", "Pro(O->S)": "P", "dPro(O->S)": "P",
    "dHyp": "P", "Pip": "P", "Pye": "P", "dPye": "P", "Aib": "A", "dAbu": "A",
    "Me_dAbu": "A", "dAla(O->S)": "A", "Ala(O->S)": "A", "Ala(5-Tet)": "A",
    "Ala(indol-2-yl)": "A", "Me_Ala(indol-2-yl)": "A", "dAla(indol-2-yl)": "A",
    "Gly": "G", "Bn_Gly": "G", "Pr_Gly": "G", "Et_Gly": "G", "MeOEt_Gly": "G",
    "iBu_Gly": "G", "NH2Bu_Gly": "G", "cHexCH2_Gly": "G", "PhPr_Gly": "G",
    "3-pyridylethyl_Gly": "G", "d(N->O)Gly(allyl)": "G", "Tle": "L", "Bal": "A",
    "Bal(3-Me)": "A", "Bal(d3-CF3)": "A", "HOCOCH2_Bal": "A", "Me_Bal": "A",
    "Sta": "L", "Sta(3R,4R)": "L", "Chg": "L", "Me_Cha": "F", "dCha": "F",
    "Me_Nle": "L", "Me_dNle": "L", "dNle": "L", "Me_Nva": "V", "Me_dNva": "V",
    "dNva": "V", "Nva(Ph)": "V", "pentyl_Gly": "G", "Bn(4-Cl)_Gly": "G",
    "GABA": "G", "Me_Abu": "A", "Me_Bmt(E)": "T", "Aoc(2)": "L", "5-Ava": "G",
    "Cys(EtO2H)_NH2": "C", "3Pal": "F", "HOCOCH2_Gly_ol": "G", "Glu_NH2": "Q",
    "Tza": "P", "Asp_piperidide": "D", "Me_Phe(a,b-dehydro)": "F", "2Abz": "F",
    "(N->O)xiIle": "I", "(N->O)Tyr": "Y",
}

# Name patterns that identify a sequence or a label column.
SEQUENCE_NAME_PARTS = ("sequence", "seq", "peptide", "protein", "smiles")
LABEL_NAME_PARTS = ("value", "target", "label", "activity")
PERMEABILITY_NAME_PARTS = ("permeability", "logp", "papp")

# Attribution blocks of the features; anything not listed is block C.
ATTRIBUTION_A = (*DESCRIPTORS, "num_edits", "num_edit_families")
ATTRIBUTION_B1 = (
    "anchor_count_total",
    "anchor_count_unique",
    "anchor_density",
    "anchor_pos_mean",
    "anchor_pos_std",
    "anchor_pos_range",
)
ATTRIBUTION_B2_PREFIX = "anchor_res_"
ATTRIBUTION_B3 = (
    "anchor_hydrophobic_frac",
    "anchor_charged_frac",
    "anchor_polar_frac",
    "anchor_aromatic_frac",
    "anchor_small_frac",
    "anchor_proline_frac",
    "anchor_terminal_frac",
    "anchor_n_terminal_count",
    "anchor_c_terminal_count",
)

# Rule ids by which published records can be joined.
RULE_IDS = {
    "acetyl": "cycpept_n_acetyl_v1",
    "tail": "cycpept_c_term_v1",
    "mirrored": "cycpept_d_aa_v1",
    "methylated": "cycpept_n_methyl_v1",
    "replaced": "cycpept_nonstandard_v1",
    "ring": "cycpept_circle_v1",
    "branch": "cycpept_lariat_v1",
}
