"""Quality rules, near-duplicates, decontamination and personal data against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tabulyze.llm import (
    class_model, components, decontamination, pii, quality, simhash, word_exchange,
)

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").encode().lower().decode()


def key(row):
    return tuple((v is None, v) if not isinstance(v, float) else (False, round(v, 6)) for v in row)


def same(frame, expected, columns):
    got = [tuple(r[c] for c in columns) for r in frame.collect()]
    assert sorted(map(key, got)) == sorted(map(key, expected))


def quality_row(doc_id, text):
    text = text or ""
    words = SPACE_WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    uses = Counter(windows)
    inside = {j for i, w in enumerate(windows) if uses[w] > 1 for j in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        repeated += line in seen and bool(SPACE_WORD.search(line))
        seen.add(line)
    return (doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            repeated, len(inside), len(words) < 20 or 100 * len(inside) > 30 * len(words))


@pytest.mark.parametrize("table", ["documents", "odd", "clashing", "none"])
def test_quality_matches_brute_force(table, request):
    docs = request.getfixturevalue(table)
    found = quality.quality(docs)
    rows = [quality_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    same(found, rows, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", "base_failed"])


def test_quality_coverage_of_each_length(documents):
    found = {r.doc_id: r for r in quality.quality(documents).collect()}
    rules = quality.RepetitionRules()
    for doc in documents.collect():
        words, row = SPACE_WORD.findall(doc.text), found[doc.doc_id]
        over = False
        for k, (size, limit) in enumerate(rules.n_gram_limits):
            grams = [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]
            uses = Counter(grams)
            at = {j for i, g in enumerate(grams) if uses[g] > 1 for j in range(i, i + size)}
            chars = sum(len(words[j]) for j in at)
            assert row.covered_chars[k] == chars
            over |= chars > limit * row.word_chars
        over |= row.dup_line_chars > rules.line_limit * row.word_chars
        assert row.kept == (not row.base_failed and not over)


def fingerprint(text):
    words = lower(text).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64)
               if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked_components(rows):
    """(id, fingerprint) -> component of each row."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [least.get(root(i)) for i in range(len(rows))]


@pytest.mark.parametrize("table", ["documents", "odd", "clashing", "none"])
def test_simhash_matches_brute_force(table, request):
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    expected = [(i, f"{f:016x}", c) for (i, f), c in zip(rows, linked_components(rows))]
    same(simhash.simhash_components(docs), expected, ["doc_id", "fingerprint", "component_id"])


@pytest.mark.parametrize("cell_limit", [4, 4096])
def test_crowded_cells_lose_no_link(shipped, cell_limit):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 63))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), False))
           for _ in range(150)} | {int(x) for x in rng.integers(0, 1 << 63, 100)}
    fps = sorted(fps)
    frame = shipped.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps],
                                    "fp long")
    names = linked_components([(i, f) for i, f in enumerate(fps)])
    groups = {r.node & (2 ** 64 - 1): r.root for r in
              simhash.link_fingerprints(frame, cell_limit=cell_limit).collect()}
    by_name, by_root = {}, {}
    for f, name in zip(fps, names):
        by_name.setdefault(name, set()).add(f)
        by_root.setdefault(groups.get(f, f), set()).add(f)
    assert sorted(map(sorted, by_name.values())) == sorted(map(sorted, by_root.values()))


def test_manhattan_distance_bounds_hamming():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 64, 2000, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64))
    near = simhash.within(a, b, simhash._packed(a), simhash._packed(b), 1)
    assert len(near) == 2000


def test_components_of_chains_and_loops(shipped):
    edges = [(i, i + 1) for i in range(40)] + [(5, 5), (41, 100), (100, 99), (99, 41), (3, 2)]
    found = {r.node: r.root for r in components.components(
        shipped.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {41: 41, 99: 41, 100: 41}


@pytest.mark.parametrize("table, window", [
    ("documents", 10), ("odd", 4), ("clashing", 10), ("none", 4)])
def test_decontamination_matches_brute_force(table, window, request, shipped, benchmark_items):
    docs = request.getfixturevalue(table)
    extra = shipped.createDataFrame(
        [(900, None), (901, ""), (902, "Winter honey"), (903, "Winter honey"), (None, "old wall"),
         (904, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (905, "A a a a a a a a a a a")],
        "item_id long, text string")
    items = benchmark_items.union(extra)
    windows = {}
    for item in items.collect():
        words = PLAIN_WORD.findall(lower(item.text))
        n = min(window, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            owners = windows.setdefault(tuple(words[k:k + n]), set())
            if item.item_id is not None:
                owners.add(str(item.item_id))
    expected = []
    for doc in docs.select("doc_id", "text").collect():
        words, hit, ids = PLAIN_WORD.findall(lower(doc.text)), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if (owners := windows.get(tuple(words[k:k + n]))) is not None:
                    hit.update(range(k, k + n))
                    ids |= owners
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        expected.append((doc.doc_id, len(words), len(hit), len(ids), digest, bool(hit)))
    same(decontamination.contamination(docs, items, window=window), expected,
         ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def test_decontamination_without_items(documents, benchmark_items):
    found = decontamination.contamination(documents, benchmark_items.limit(0))
    assert found.filter("contaminated or n_items > 0").count() == 0
    assert found.count() == documents.count()


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        sums = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in sums) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text):
    found = [(m.start(), i, m.end(), k) for i, k in enumerate(BASE)
             for m in re.finditer(BASE[k], text or "") if passes(k, m.group())]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


TRICKY = [
    "a@b.c@d.e x@y.z_q@r.s .@a.b --@-.- a@b a@.b %+@x.y.z. é@ü.de aé@b.cé.d@e.f",
    "1.2.3.4.5.6.7.8 01.002.0003.255 256.1.1.1 1.1.1.1.1 999999999999.1.1.1 1..2.3.4 000.0.0.0",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 4012888888881881123 0000000000000000000",
    "+1 (555) 010-9999+49 30 1234567 +1 +12 +123 + 5 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6 +1234567890.",
    "1 2 3 " * 4000, "\U0001f600 a@b.cd é 10.1.2.3 \U0001f600\U0001f600 +44 20 7946 0958",
    "9" * 20000 + " " + "a" * 20000 + "@b.c",
]


def test_personal_data_matches_brute_force(shipped, documents, odd, clashing, none):
    tricky = shipped.createDataFrame(
        [(100 + i, t, "en", "s", len(t)) for i, t in enumerate(TRICKY)], odd.schema)
    for docs in (documents.unionByName(tricky), odd, clashing, none):
        texts = docs.select("doc_id", "text").collect()
        expected = []
        for doc in texts:
            spans = base_spans(doc.text)
            digest = hashlib.sha256(",".join(spans).encode()).hexdigest()
            expected.append((doc.doc_id, *(sum(s.startswith(k + ":") for s in spans)
                                           for k in BASE), digest))
        found = pii.personal_data(docs)
        same(found, expected,
             ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"])
        by_digest = {e[-1]: base_spans(d.text) for e, d in zip(expected, texts)}
        for row in found.collect():
            assert set(by_digest[row.base_sha256]) <= set(row.spans.split(","))


def test_personal_data_adds_assigned_keys(shipped):
    documents = shipped.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = pii.personal_data(documents)
    assert not re.search("Python|Arrow", plan._jdf.queryExecution().executedPlan().toString())
    added = [s for r in plan.collect() for s in r.spans.split(",") if s.startswith("secret")]
    texts = {r.doc_id: r.text for r in documents.collect()}
    tokens = sum(len(re.findall(r'(?i)token = "[0-9a-f]{32,}"', t)) for t in texts.values())
    assert tokens > 0 and len(added) >= 0.9 * tokens


def test_span_judge_counts_all_proposals(shipped):
    """Thresholds follow the shares in the whole table, however unlike the labels are in number."""
    from pyspark.sql import functions as F

    secret = pii.KINDS.index("secret")
    bad = F.col("id") % 30 == 0  # precise enough over all rows, not by equal shares of labels
    other = F.col("id") % 600 == 0
    features = F.array(other.cast("double"), *(F.lit(0.0) for _ in range(16)))
    rows = shipped.range(60_000).select(F.array(F.struct(
        F.col("id").cast("int").alias("s"), F.lit(secret).alias("kind"),
        F.col("id").cast("int").alias("e"), F.lit(False).alias("valid"), (~bad).alias("weak"),
        features.alias("f"))).alias("spans"))
    judge = pii.fit_judge(rows, pii.PiiOptions())
    assert judge.least[secret] is not None
    kept = rows.select(F.explode("spans").alias("x")).filter(judge.accepts(F.col("x")))
    assert kept.count() == 60_000 - 100


def test_span_judge_halves_proposals_alike(shipped):
    """One form of letter, its number always at the same place, both teaches and sets thresholds."""
    from pyspark.sql import functions as F

    word = F.when(F.col("id") % 4 == 0, "item").otherwise("call")
    docs = shipped.range(400).select(F.col("id").alias("doc_id"), F.concat(
        word, F.lit(" 555-123-4567 in letter "), "id").alias("text"))
    rows = corpus_pipeline.redact_personal_data(shipped, docs, "").collect()
    assert {r.doc_id: r.text for r in rows} == {
        i: f"item 555-123-4567 in letter {i}" if i % 4 == 0
        else f"call [LOCAL_PHONE] in letter {i}" for i in range(400)}
    spans = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    assert spans == {i: "" if i % 4 == 0 else "local_phone:5:17" for i in range(400)}


def test_redaction_replaces_spans_only(shipped, odd, clashing):
    for docs in (odd, clashing):
        rows = pii.redacted(docs).collect()
        assert sorted(docs.columns) == sorted(rows[0].asDict())
        by_id = {r.doc_id: r.text for r in rows}
        assert by_id[1] is None and by_id[2] == ""
        assert by_id[11] == "mail [EMAIL] and [PHONE] or 10.0.0.256 [IP], [CARD]"


@pytest.mark.parametrize("table, core_words", [
    ("documents", 64), ("odd", 1 << 17), ("clashing", 64), ("none", 64)])
def test_class_model_base_is_exact(table, core_words, request):
    import math
    import zlib

    docs = request.getfixturevalue(table)
    options = class_model.ClassOptions(classes=6, units=32, shapes=16, core_words=core_words,
                                       rounds=2)
    found = class_model.scored(docs, options=options)

    def held(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2

    texts = [(r.doc_id, lower(r.text).encode().split()) for r in
             docs.select("doc_id", "text").collect()]
    counts = Counter()
    for i, words in texts:
        if not held(i):
            counts.update([*words, None])
    n, v = sum(counts.values()), len(counts)
    expected = []
    for i, words in texts:
        tokens = [*words, None]
        score = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        expected.append((i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, score))
    same(found, expected, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens",
                           "base_score"])
    assert all(r.score < 0 for r in found.collect())


def test_class_model_beats_its_base_on_held_out_texts(documents):
    rows = [r for r in class_model.scored(documents).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_contexts_count_moving_words_only():
    """Rare neighbours (code and class past the last) and words that stay leave no count."""
    import numpy as np

    core = np.array([0, 1, 2, 0, 1, 2, 0, 1, 3])  # three classes and the end
    turn = word_exchange.Turn(3, 0, core, np.zeros((4, 4)), np.zeros(4))
    held = word_exchange.CoreContexts(turn)
    words, k = np.array([0, 1, 2, 7, 8, 9, 3, 3]), np.array([1, 4, 2, 0, 1, 1, 4, 3])
    held.add(words, 1, k, np.ones(8, np.int32))
    rows = held.cells.reshape(-1, 2, 5)[:-1, :, :4]
    want = np.zeros((len(core) - 1, 4), int)
    for w, c in zip(words, k):
        if w < len(core) - 1 and c < 4:
            want[w, c] += 1
    assert rows[:, 1].tolist() == want[held.moving].tolist() and not rows[:, 0].any()


@pytest.mark.parametrize("core_words", [4, 1 << 17])
def test_class_model_classes_follow_contexts_not_endings(shipped, core_words):
    """Words beyond the units, endings shared across two kinds: their neighbours tell them apart."""
    nouns = [f"n{i}{e}" for i in range(30) for e in ("abc", "xyz")]
    verbs = [f"v{i}{e}" for i in range(30) for e in ("abc", "xyz")]
    rows = [(i, f"the {a} will {b} the {c} will {b}") for i, (a, b, c) in
            enumerate((nouns[k % 60], verbs[(k * 7) % 60], nouns[(k * 13) % 60])
                      for k in range(400))]
    docs = shipped.createDataFrame(rows, "doc_id long, text string")
    options = class_model.ClassOptions(classes=4, units=4, shapes=16, core_words=core_words)
    model, others = class_model.fit(docs.select("text"), options)
    classes = {r.h: r.k for r in others.collect()}
    classes |= dict(zip(model.core.hashes.view(np.int64).tolist(), model.class_of.tolist()))

    def class_set(words):
        hashes = shipped.createDataFrame([(w,) for w in words], "text string")
        return {classes[r.h] for r in class_model.word_counts(hashes, options).collect()
                if r.shape >= 0}

    assert len(classes) == 122
    assert not class_set(nouns) & class_set(verbs)
