"""Feature, window and perturbation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from annoframe.functions import constants as C
from annoframe.functions import sequences as S
from annoframe.operators import features, perturb
from annoframe.plans.base import load, query, r, rounded, sql_unit
from annoframe.plans.samples import KEYS, PRELUDE, samples


def _share(letters: str, name: str) -> str:
    inside = ", ".join(f"'{a}'" for a in letters)
    return r(f"coalesce(sum(CASE WHEN res IN ({inside}) THEN 1 ELSE 0 END) * 1.0 / count(*), 0)", name)


_ANCHORS = """
anc AS (SELECT id, seq, n, unnest(pos) AS p FROM ann WHERE kind <> 'global' AND len(pos) > 0),
ancr AS (SELECT *, substr(seq, p + 1, 1) AS res FROM anc)
"""

_B1 = ", ".join(
    [
        r("count(*)", "anchor_count_total"),
        r("count(DISTINCT p)", "anchor_count_unique"),
        r("count(DISTINCT p) * 1.0 / max(n)", "anchor_density"),
        r("avg(p)", "anchor_pos_mean"),
        r("stddev_pop(p)", "anchor_pos_std"),
        r("max(p) - min(p)", "anchor_pos_range"),
    ]
)
_B2 = ", ".join(_share(a, f"anchor_res_{a}") for a in C.LETTERS)
_B3 = ", ".join(_share(g, f"anchor_{k}_frac") for k, g in C.ANCHOR_GROUPS.items())


def _fill(names) -> str:
    return ", ".join(f"coalesce({n}, 0.0) AS {n}" for n in names)


_SITE_NAMES = [*C.ATTRIBUTION_B1, *[f"anchor_res_{a}" for a in C.LETTERS], *C.ATTRIBUTION_B3[:6]]

SITE_SQL = f"""
WITH {PRELUDE}, {_ANCHORS},
b AS (SELECT id, {_B1}, {_B2}, {_B3} FROM ancr GROUP BY id),
t AS (
  SELECT id, count(*) AS ne, sum(CASE WHEN family = 'n_terminal' THEN 1 ELSE 0 END) AS nt,
         sum(CASE WHEN family = 'c_terminal' THEN 1 ELSE 0 END) AS ct FROM ann GROUP BY id)
SELECT o.id, {_fill(_SITE_NAMES)},
       {r("CASE WHEN b.id IS NULL THEN 0 ELSE (nt + ct) * 1.0 / ne END", "anchor_terminal_frac")},
       {r("CASE WHEN b.id IS NULL THEN 0 ELSE nt END", "anchor_n_terminal_count")},
       {r("CASE WHEN b.id IS NULL THEN 0 ELSE ct END", "anchor_c_terminal_count")}
FROM o LEFT JOIN b ON b.id = o.id LEFT JOIN t ON t.id = o.id
"""


@query("site_features", SITE_SQL)
def site_features(spark, sf):
    """Anchor positions, residues and properties of every sample (FE6-FE9, FE14)."""
    return rounded(features.select_blocks(samples(spark, sf), "site_only", ["id"]))


def _count(cond: str, name: str) -> str:
    return r(f"coalesce(sum(CASE WHEN {cond} THEN 1 ELSE 0 END), 0)", name)


_NAMED = ", ".join(f"'{t}'" for t in C.COUNTED_TYPES)
CONTEXT_SQL = f"""
WITH {PRELUDE}, {_ANCHORS},
over AS (SELECT id, count(*) AS k FROM (
  SELECT id, p FROM anc GROUP BY id, p HAVING count(*) > 1) GROUP BY id),
c AS (
  SELECT id, count(*) AS ne, {", ".join(_count(f"family = '{f}'", f"edit_family_{f}") for f in C.FAMILIES)},
    {r("count(DISTINCT type)", "edit_type_count_unique")}, {r("entropy(type)", "edit_type_entropy")},
    {r("count(DISTINCT family || '_' || raw)", "attachment_type_count_unique")},
    {r("max(CASE WHEN family = 'cyclization' THEN 1 ELSE 0 END)", "has_cyclization")},
    {r("max(CASE WHEN family = 'backbone' THEN 1 ELSE 0 END)", "has_backbone_mod")},
    {", ".join(_count(f"type = '{t}'", f"edit_type_{t}") for t in C.COUNTED_TYPES)},
    {_count(f"type NOT IN ({_NAMED})", "edit_type_other")},
    {_count("len(pos) > 1", "anchor_pair_count")},
    {r("coalesce(max(ring_size), 0)", "cyclization_ring_size")},
    {r("max(CASE WHEN family = 'cyclization' THEN 1 ELSE 0 END)", "sequence_cyclic")}
  FROM ann GROUP BY id)
SELECT o.id, {_fill([n for n in features.feature_names("context_only")
                     if n not in ("edit_anchor_overlap", "sequence_length", "modification_rate")])},
       {r("coalesce(over.k, 0)", "edit_anchor_overlap")}, {r("length(o.seq)", "sequence_length")},
       {r("coalesce(ne, 0) * 1.0 / length(o.seq)", "modification_rate")}
FROM o LEFT JOIN c ON c.id = o.id LEFT JOIN over ON over.id = o.id
"""


@query("context_features", CONTEXT_SQL)
def context_features(spark, sf):
    """Annotation families, types, entropy and aggregates of every sample (FE10-FE13)."""
    return rounded(features.select_blocks(samples(spark, sf), "context_only", ["id"]))


@query(
    "sample_keys",
    f"""WITH {PRELUDE}, {KEYS},
    ex AS (SELECT id, string_agg(CAST(pos[1] AS VARCHAR) || ':' || type || '/' || raw, ';' ORDER BY idx) AS t
           FROM ann WHERE kind = 'explicit' AND len(pos) > 0 GROUP BY id),
    mp AS (SELECT id, string_agg(CAST(q AS VARCHAR), ',' ORDER BY q) AS t FROM (
           SELECT id, unnest(pos) AS q FROM ann) GROUP BY id)
    SELECT s.id, scaffold, profile, anchor_status, coalesce(ex.t, '') AS anchors,
           coalesce(mp.t, '') AS modified, profile LIKE '%cyclization%' AS cyclic
    FROM s LEFT JOIN ex ON ex.id = s.id LEFT JOIN mp ON mp.id = s.id""",
)
def sample_keys(spark, sf):
    """Scaffold and profile keys, status, explicit anchors, positions, ring flag (SC5-SC8, CV8)."""
    df = samples(spark, sf)
    edits = F.col("edits")
    anchors = F.transform(
        S.explicit_anchors(edits),
        lambda a: F.concat(a["position"].cast("string"), F.lit(":"), a["text"]),
    )
    spots = S.modified_positions(F.flatten(F.transform(edits, lambda e: e["anchor_positions"])))
    ring = F.get(S.of_family(edits, "cyclization"), F.lit(0))
    return df.select(
        "id",
        S.scaffold_key(F.col("sequence"), edits).alias("scaffold"),
        S.profile_key(edits).alias("profile"),
        S.anchor_status(edits).alias("anchor_status"),
        F.array_join(anchors, ";").alias("anchors"),
        F.array_join(F.transform(spots, lambda p: p.cast("string")), ",").alias("modified"),
        S.is_cyclic(ring).alias("cyclic"),
    )


def _n_of(letters: str) -> str:
    return f"(length(s) - length(translate(s, '{letters}', '')))"


def _weighted(table: dict) -> str:
    return " + ".join(f"{_n_of(a)} * ({float(v)})" for a, v in table.items())


COMPOSITION_SQL = f"""
WITH x AS (SELECT p_partkey, upper(p_name) AS s, length(p_name) * 1.0 AS n FROM part)
SELECT p_partkey, {", ".join(r(f"{_n_of(a)} / n", f"aa_{a}") for a in C.LETTERS)},
  {", ".join(r(f"{_n_of(g)} / n", f"prop_{k}") for k, g in C.PROPERTY_GROUPS.items())},
  {r("n", "length")}, {r(_weighted(C.MASS), "molecular_weight")},
  {r(f"{_n_of('KR')} - {_n_of('DE')}", "charge")}, {r(f"({_weighted(C.HYDROPATHY)}) / n", "hydrophobicity")},
  {r(f"{_n_of('FYW')} / n", "aromaticity")} FROM x
"""


@query("composition_features", COMPOSITION_SQL)
def composition_features(spark, sf):
    """Letter shares, group shares and basic properties of part names (FE1, FE2, FE4, FE5)."""
    cols = features.composition_vector(F.col("p_name"))
    return rounded(load(spark, sf, "part").select("p_partkey", *cols))


@query(
    "bigram_features",
    f"""WITH x AS (SELECT p_partkey, upper(p_name) AS s FROM part),
    w AS (SELECT p_partkey, substr(s, i, 2) AS pair, length(s) - 1 AS m
          FROM (SELECT *, unnest(range(1, length(s))) AS i FROM x))
    SELECT p_partkey, pair, {r("count(*) * 1.0 / max(m)", "share")} FROM w
    WHERE regexp_matches(pair, '^[{C.LETTERS}][{C.LETTERS}]$') GROUP BY p_partkey, pair""",
)
def bigram_features(spark, sf):
    """Shares of letter pairs in part names, in long form (FE3)."""
    df = load(spark, sf, "part")
    shares = features.bigram_map(F.col("p_name"))
    return rounded(df.select("p_partkey", F.explode(shares).alias("pair", "share")))


@query(
    "context_windows",
    """WITH x AS (SELECT p_partkey, p_name AS s, length(p_name) AS n, p_size % length(p_name) AS p,
                       upper(p_type) AS t FROM part)
    SELECT p_partkey, substr(s, greatest(0, p - 3) + 1, least(n, p + 4) - greatest(0, p - 3)) AS cut,
           substr(t, greatest(0, p - 3) + 1,
                  greatest(0, least(length(t), p + 4) - greatest(0, p - 3))) AS target_cut,
           lpad(substr(s, greatest(0, p - 3) + 1, p - greatest(0, p - 3)), 3, '-') AS before,
           substr(s, p + 1, 1) AS anchor, rpad(substr(s, p + 2, 3), 3, '-') AS after,
           levenshtein(s, lower(t)) AS distance FROM x""",
)
def context_windows(spark, sf):
    """Cut and padded windows around a position of the part name (SC1, SC2, SC11)."""
    df = load(spark, sf, "part").withColumn("p", F.col("p_size") % F.length("p_name"))
    name, kind = F.col("p_name"), F.upper("p_type")
    ctx = S.context(name, F.col("p"))
    pair = S.pair_window(name, kind, F.col("p"))
    return df.select(
        "p_partkey",
        S.window(name, F.col("p")).alias("cut"),
        pair["target"].alias("target_cut"),
        ctx["before"].alias("before"),
        ctx["anchor"].alias("anchor"),
        ctx["after"].alias("after"),
        S.edit_distance(name, F.lower(kind)).alias("distance"),
    )


def _window_sql() -> str:
    cols = []
    for d in range(-2, 3):
        letter = f"CASE WHEN p + ({d}) >= 0 AND p + ({d}) < n THEN substr(seq, p + ({d}) + 1, 1) END"
        hydro = " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.HYDROPATHY.items())
        charge = " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.WINDOW_CHARGE.items())
        large = ", ".join(f"'{k}'" for k in C.WINDOW_LARGE)
        name = f"pos{d}" if d >= 0 else f"pos{d}"
        cols += [
            r(f"avg(CASE {letter} {hydro} ELSE 0 END)", f'"{name}_hydrophobicity"'),
            r(f"avg(CASE {letter} {charge} ELSE 0 END)", f'"{name}_charge"'),
            r(f"avg(CASE WHEN ({letter}) IN ({large}) THEN 1 ELSE 0 END)", f'"{name}_size"'),
        ]
    cols.append(r("avg(p * 1.0 / n)", "normalized_position"))
    names = ", ".join(f'coalesce("{n}", 0.0) AS "{n}"' for n in features.window_names())
    return f"""WITH {PRELUDE}, f AS (SELECT id, seq, n, pos[1] AS p FROM ann WHERE len(pos) > 0),
    g AS (SELECT id, {", ".join(cols)} FROM f GROUP BY id)
    SELECT o.id, {names} FROM o LEFT JOIN g ON g.id = o.id"""


@query("window_features", _window_sql())
def window_features(spark, sf):
    """Mean window properties at the first position of each annotation (FE16)."""
    return rounded(features.window_mean(samples(spark, sf), ["id"]))


@query(
    "count_features",
    f"""WITH {PRELUDE}, c AS (SELECT id, count(*) AS ne, count(DISTINCT family) AS nf,
        {", ".join(f"sum(CASE WHEN family = '{f}' THEN 1 ELSE 0 END) AS {f}" for f in C.FAMILIES)}
        FROM ann GROUP BY id)
    SELECT o.id, {r("coalesce(ne, 0)", "num_edits")}, {r("coalesce(nf, 0)", "num_edit_families")},
    {", ".join(r(f"coalesce({f}, 0)", f"edit_family_{f}") for f in C.FAMILIES)},
    {r("coalesce(ne, 0)", "total_edits")},
    {", ".join(r(f"coalesce({f}, 0)", f"count_{f}") for f in sorted(C.FAMILIES))}
    FROM o LEFT JOIN c ON c.id = o.id""",
)
def count_features(spark, sf):
    """Annotation counts, fixed and by the families seen in training (FE15, FE17)."""
    df = samples(spark, sf)
    seen = features.seen_families(df)
    edits = F.col("edits")
    return rounded(
        df.select("id", *features.count_features(edits), *features.family_counts(edits, seen))
    )


@query(
    "profile_one_hot",
    f"""WITH {PRELUDE}, {KEYS}
    SELECT id, CASE WHEN profile = 'no_edits' THEN 1.0 ELSE 0.0 END AS profile_no_edits,
           CASE WHEN profile = 'backbone' THEN 1.0 ELSE 0.0 END AS profile_backbone,
           CASE WHEN profile = 'cyclization' THEN 1.0 ELSE 0.0 END AS profile_cyclization FROM s""",
)
def profile_one_hot(spark, sf):
    """0/1 columns for chosen profiles (LK3)."""
    df = samples(spark, sf).select("id", S.profile_key(F.col("edits")).alias("profile"))
    hot = features.one_hot(df, "profile", ["no_edits", "backbone", "cyclization"])
    return hot.drop("profile")


@query(
    "descriptor_join",
    f"""WITH l AS (SELECT l_partkey, count(*) AS n, avg(l_quantity) AS q FROM lineitem GROUP BY 1)
    SELECT p_partkey, coalesce(n, 0) AS n_lines,
           {r("coalesce(CASE WHEN q > 0 THEN q END, 0)", "mean_quantity")},
           {r("coalesce(ln(nullif(n - 1, 0)), 0)", "log_lines")}
    FROM part LEFT JOIN l ON l_partkey = p_partkey""",
)
def descriptor_join(spark, sf):
    """Numeric descriptors joined by key; missing and non-finite become 0 (JN13, SC13)."""
    desc = load(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"), F.avg("l_quantity").alias("mean_quantity")
    )
    log = F.when(F.col("n_lines") > 1, F.log(F.col("n_lines") - 1)).otherwise(float("-inf"))
    desc = desc.select(F.col("l_partkey").alias("p_partkey"), "n_lines", "mean_quantity", log.alias("log_lines"))
    part = load(spark, sf, "part").select("p_partkey")
    out = features.join_descriptors(part, desc, "p_partkey", ["n_lines", "mean_quantity", "log_lines"], salt=4)
    return rounded(out.withColumn("n_lines", F.col("n_lines").cast("bigint")))


_STEPS = [d for d in range(-5, 6) if d]
_OPTIONS = " UNION ALL ".join(
    f"SELECT id, p, n, p + ({d}) AS c, {sql_unit('42', 'id', 'p', str(d))} AS u FROM f" for d in _STEPS
)
PERTURB_SQL = f"""
WITH {PRELUDE},
f AS (SELECT id, idx, n, pos[1] AS p FROM ann WHERE kind = 'explicit' AND len(pos) > 0),
opts AS ({_OPTIONS}),
wrong AS (SELECT id, p, arg_min(c, u) AS w FROM opts WHERE c >= 0 AND c < n GROUP BY id, p)
SELECT f.id, f.idx, f.p AS original,
  CAST(coalesce(w, CASE WHEN f.p < n // 2 THEN n - 1 ELSE 0 END) AS INTEGER) AS wrong,
  CAST(least(greatest(0, CASE WHEN f.p < n // 3 THEN n // 3 // 2 WHEN f.p < 2 * (n // 3)
       THEN n // 3 + n // 3 // 2 ELSE 2 * (n // 3) + n // 3 // 2 END), n - 1) AS INTEGER) AS tertile,
  CAST(least(greatest(0, f.p + {sql_unit("'42:noise'", "f.id", "f.p")} % 7 - 3), n - 1) AS INTEGER) AS noisy,
  least(greatest(0, f.p + 2), n - 1) AS shifted, least(greatest(0, f.p - 4), n - 1) AS shifted_back
FROM f LEFT JOIN wrong ON wrong.id = f.id AND wrong.p = f.p
"""


@query("perturbed_anchors", PERTURB_SQL)
def perturbed_anchors(spark, sf):
    """Wrong, coarse, noisy and shifted anchors of explicit annotations (PE1-PE4)."""
    df = samples(spark, sf).withColumn("n", F.length("sequence"))
    rows = df.select("id", "n", F.posexplode("edits").alias("idx", "e"))
    rows = rows.filter((F.col("e.anchor_kind") == "explicit") & (F.size("e.anchor_positions") > 0))
    rows = rows.withColumn("p", F.get("e.anchor_positions", F.lit(0)))
    p, n, key = F.col("p"), F.col("n"), F.col("id")
    return rows.select(
        "id",
        "idx",
        p.alias("original"),
        perturb.wrong_anchor(p, n, key).alias("wrong"),
        perturb.tertile(p, n).alias("tertile"),
        perturb.noise(p, n, key).alias("noisy"),
        perturb.shift(p, n, 2).alias("shifted"),
        perturb.shift(p, n, -4).alias("shifted_back"),
    )


@query(
    "token_fingerprints",
    """WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'),
                   lambda t: t <> '')) AS words FROM documents),
    slots AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 2048 AS slot
              FROM (SELECT doc_id, unnest(words) AS w FROM d))
    SELECT d.doc_id, count(DISTINCT slot) AS n_slots, coalesce(sum(DISTINCT slot), 0) AS slot_sum
    FROM d LEFT JOIN slots ON slots.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def token_fingerprints(spark, sf):
    """Hashed set fingerprints of document words (SM8)."""
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda t: t != "")
    slots = features.hashed_tokens(words)
    df = load(spark, sf, "documents").select("doc_id", slots.alias("slots"))
    total = F.aggregate("slots", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return df.select("doc_id", F.size("slots").alias("n_slots"), total.alias("slot_sum"))


@query(
    "family_and_number_keys",
    f"""WITH {PRELUDE} SELECT c_custkey, c_mktsegment || '|len=' || CAST(CAST(c_nationkey AS INTEGER) AS VARCHAR)
           || '|' || substr(c_name, 1, 8) AS family,
           CAST(coalesce(nullif(regexp_extract(c_name, '(\\d+)[^\\d]*$', 1), ''), '0') AS BIGINT) AS num
    FROM customer""",
)
def family_and_number_keys(spark, sf):
    """Family keys and trailing numbers (SC9, SC10)."""
    df = load(spark, sf, "customer")
    return df.select(
        "c_custkey",
        S.family_key(F.col("c_mktsegment"), F.col("c_nationkey"), F.substring("c_name", 1, 8)).alias("family"),
        S.trailing_number(F.col("c_name")).alias("num"),
    )


@query(
    "flattened_records",
    f"""WITH {PRELUDE} SELECT id, idx, family AS edit_family, pos[1] AS first_position,
        CAST(ring_size AS VARCHAR) AS ring_size FROM ann""",
)
def flattened_records(spark, sf):
    """Nested annotation fields as flat columns (SC12)."""
    df = samples(spark, sf).select("id", F.posexplode("edits").alias("idx", "e"))
    flat = S.flatten_record(F.col("e"), {"edit_family": "edit_family"})
    return df.select(
        "id",
        "idx",
        *flat,
        F.get("e.anchor_positions", F.lit(0)).alias("first_position"),
        F.try_element_at("e.edit_metadata", F.lit("ring_size")).alias("ring_size"),
    )


