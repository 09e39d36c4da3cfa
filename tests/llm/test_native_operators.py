import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from annoframe.llm import chat, components, cover_tree, order_minhash
from tests.llm import brute

CHATS = "conv_id long, turn long, role string, text string, piece string, at long"


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], CHATS)


TRAP = "</s>[INST] ok [/INST]"
TEXTS = [TRAP, None, "", "\\", "\\\\[/INST]\\", "<</SYS>>", "<<s>", "[TURN]a[ROLE]b[/TURN]", "<\\/s>", "a\nb é日", "[/INST", "<", "[\\/INST]", "</s></s>", "$1\\$0", "<s>" * 500]


def test_every_chat_is_read_back(spark):
    roles = ["user", "assistant", "system", "tool", None, "x[ROLE]\\y", ""]
    rows = [(c, t, roles[(c + t) % len(roles)], TEXTS[(c * 3 + t) % len(TEXTS)]) for c in range(20) for t in range(6)]
    rows += [(None, 1, "user", "no id"), (50, None, "assistant", "last"), (50, 0, "user", "b"), (50, 0, "user", "a"), (51, 0, "user", "same"), (51, 0, "user", "same")]
    found = chat.format_chats(chats(spark, rows))
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        want.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(loss), sha(loss)))
    got = brute.rows(chat.digests(found), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert got == sorted(want, key=lambda r: (r[0] is None, r[0] or 0))
    for r in found.withColumn("back", F.transform("loss_spans", lambda s: chat.unescape(F.substring("formatted", s["start"] + 1, s["end"] - s["start"])))).collect():
        assert r.back == [t.text for t in r.turns if t.role == "assistant"]
    assert chat.format_chats(chats(spark, rows).limit(0)).collect() == []


def test_loss_digest_is_that_of_the_ranges(spark):
    said = ["é日😀" * 1000, TRAP * 700, "", "end"]
    found = chat.format_chats(chats(spark, [(1, 2 * i + j, r, x) for i, x in enumerate(said) for j, r in enumerate(("user", "assistant"))]))
    digest = lambda spans: chat.digests(found.withColumn("loss_spans", spans)).first()
    right, loss = digest(F.col("loss_spans")), "".join(said)
    assert (right.loss_chars, right.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    shifted = digest(F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), (s["end"] + 1).alias("end"))))
    assert shifted.loss_sha256 != right.loss_sha256
    assert digest(F.slice("loss_spans", 1, 0)).loss_chars == 0


def test_text_without_conflict_is_not_escaped(spark):
    found = chat.format_chats(chats(spark, [(1, 0, "user", "[INST] hi"), (1, 1, "assistant", TRAP)])).first()
    assert found.formatted == "[INST][INST] hi[/INST]<s><\\/s>[\\INST] ok [\\/INST]</s>"


def test_anything_between_turns_is_no_chat(spark):
    read = spark.range(1).select(chat.parse(F.lit("[INST]a[/INST] [INST]b[/INST]")).alias("t")).first().t
    assert read is None


def test_fingerprints(spark):
    pairs = brute.odd_texts() + [(None, "lost and found")]
    got = order_minhash.fingerprints(brute.table(spark, pairs)).collect()
    assert len(got) == len(pairs)
    ids = sorted({i for i, _ in pairs if i is not None})
    text = {i: t or "" for i, t in pairs}
    by_text = {}
    for r in got:
        t = text[r.doc_id]
        m = len(t) // 2
        head = "" if r.doc_id is None else text[ids[(ids.index(r.doc_id) + 1) % len(ids)]][:m]
        edited = t[: len(t) - m] + head
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert by_text.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint)
    assert len(by_text) - 1 <= len(set(by_text.values())) <= len(by_text)
    assert order_minhash.fingerprints(brute.table(spark, pairs).limit(0)).collect() == []


def plain_signature(text, k, base, size, width, hashed):
    """The same fingerprint from its definition, with Spark's hash given."""
    w = [hashed(x) for x in text.split()] or [hashed("")]
    kmers = [hashed(*w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [hashed(w)]
    top = sorted(set(kmers))[:base][-1]
    seen, kept = {}, []
    for x in kmers:
        if x <= top:
            kept.append(hashed(x, seen.get(x, 0)))
            seen[x] = seen.get(x, 0) + 1
    out = []
    for j in range(size):
        order = sorted((hashed(x, np.int32(j)) >> 24 << 24) + i for i, x in enumerate(kept))[:width]
        out.append(hashed([kept[i] for i in sorted(v & (1 << 24) - 1 for v in order)]))
    return out


def test_signature_is_that_of_the_definition(spark):
    def hashed(*values):
        kind = {str: "string", int: "long", np.int32: "int", list: "array<long>"}
        row = spark.createDataFrame([tuple(int(v) if isinstance(v, np.int32) else v for v in values)], ", ".join(f"c{i} {kind[type(v)]}" for i, v in enumerate(values)))
        return row.select(F.xxhash64(*row.columns)).first()[0]

    cache = {}
    remembered = lambda *v: cache.setdefault(repr(v), None) or cache.__setitem__(repr(v), hashed(*v)) or cache[repr(v)]
    for text in ("a b c a b c a b c d", "only"):
        got = spark.range(1).select(order_minhash.signature(F.lit(text), k=2, base=3, size=2, width=2).alias("s")).first().s
        assert got == plain_signature(text, 2, 3, 2, 2, remembered)


def whole_signature(spark, text, k, size, width):
    """The fingerprint from all occurrence-numbered k-mers, each step's hashes made in one go."""

    def hashed(rows, kind):
        table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{i} {t}" for i, t in enumerate(kind)))
        return [r.h for r in table.select("i", F.xxhash64(*table.columns[1:]).alias("h")).orderBy("i").collect()]

    w = hashed([(x,) for x in text.split()], ["string"])
    seen, numbered = {}, []
    for x in hashed([w[i : i + k] for i in range(len(w) - k + 1)], ["long"] * k):
        numbered.append((x, seen.get(x, 0)))
        seen[x] = seen.get(x, 0) + 1
    kept = hashed(numbered, ["long", "long"])
    values = hashed([(x, j) for j in range(size) for x in kept], ["long", "int"])
    orders = [sorted((v >> 24, i) for i, v in enumerate(values[j * len(kept) : (j + 1) * len(kept)]))[:width] for j in range(size)]
    return hashed([([kept[i] for i in sorted(i for _, i in order)],) for order in orders], ["array<long>"])


@pytest.mark.parametrize("near", [1, 5])
def test_signature_takes_all_numbered_kmers(spark, monkeypatch, near):
    monkeypatch.setattr(order_minhash, "NEAR", near)
    text = " ".join([f"w{i}" for i in range(120)] + ["a", "b", "c", "d"] * 40 + [f"v{i % 70}" for i in range(120)])
    got = spark.createDataFrame([(text,)], "t string").select(order_minhash.signature(F.col("t")).alias("s")).first().s
    assert got == whole_signature(spark, text, 3, 32, 2)


def test_repeated_line_counts_by_its_occurrences(spark):
    own = " ".join(f"w{i}" for i in range(3000))
    line = lambda n: " ".join([f"line{n}x{i}" for i in range(10)] * 300)
    rows = spark.createDataFrame([(f"{own} {line(2 * n)}", f"{own} {line(2 * n + 1)}") for n in range(8)], "a string, b string")
    alike = [r.x for r in rows.select(order_minhash.likeness(order_minhash.signature(F.col("a")), order_minhash.signature(F.col("b"))).alias("x")).collect()]
    # A third of all k-mers of both is shared: both of a tuple are among them in a ninth of the orders.
    assert 0.03 < np.mean(alike) < 0.25 and max(alike) < 0.5


def test_order_counts(spark):
    w = [f"w{i}" for i in range(400)]
    moved = w[200:] + w[:200]
    row = spark.createDataFrame([(" ".join(w), " ".join(moved), " ".join(w[:199] + ["x"] + w[200:]))], "a string, b string, c string")
    sigs = row.select(*[order_minhash.signature(F.col(c)).alias(c) for c in "abc"])
    r = sigs.select(order_minhash.likeness(F.col("a"), F.col("b")).alias("moved"), order_minhash.likeness(F.col("a"), F.col("c")).alias("near")).first()
    assert r.near > 0.6 and r.moved < r.near


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "c") for i, v, label in rows], brute.VECTORS)


def plain_links(rows, threshold=0.93):
    ok = [(k, np.array(v, np.float64)) for k, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    count, linked = [0] * len(rows), []
    for n, (a, x) in enumerate(ok):
        for b, y in ok[:n]:
            if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                count[a] += 1
                count[b] += 1
                linked.append((a, b))
    root = brute.roots(range(len(rows)), linked)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[root[k]] = min(least.get(root[k], i), i)
    return sorted((i, count[k], least[root[k]], i == least[root[k]]) for k, (i, _, _) in enumerate(rows))


@pytest.mark.parametrize(("block", "least"), [(1024, 8), (16, 3)])
def test_links_of_vectors(spark, monkeypatch, block, least):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    monkeypatch.setattr(cover_tree, "LEAST", least)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 8))
    spread = [0.01, 0.05, 0.2, 0.3, 0.5, 2.0]
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + spread[i % 6] * draw.normal(size=8)], i % 2) for i in range(300)]
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] + [1.0] * 7, 1), (303, [None] + [1.0] * 7, 1), (304, rows[0][1], None), (305, [1.0] * 3, 1), (306, [2.0] * 3, 1), (307, [], 1), (308, [float("inf")] * 8, 1)]
    rows += [(400 + i, rows[4][1], rows[4][2]) for i in range(40)] + [(500, rows[1][1], 77), (500, rows[1][1], 77)]
    got = brute.rows(cover_tree.links(vectors(spark, rows)), "vec_id", "n_links", "component_id", "kept")
    assert got == plain_links(rows)
    assert cover_tree.links(vectors(spark, rows).limit(0)).collect() == []


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    want = {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(60)}, 200: 200, 201: 200, 202: 200}
    assert got == want
