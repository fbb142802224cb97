"""Conversation trie, n-gram join and ranked search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabulyze.llm import conversation_trie, ngram_join, ranked_search
from tabulyze.llm.parentheses import Parentheses

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TURNS = "conv_id long, turn long, role string, text string"


def lower(text):
    return (text or "").encode().lower().decode()


def rows_of(frame):
    return Counter(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("size", [1, 2, 63, 64, 65, 700, 5000])
@pytest.mark.parametrize("deep", [0.1, 0.5, 0.97])
def test_closing_parentheses(size, deep):
    rng = random.Random(size)
    bits, depth, opened = [], 0, 0
    while opened < size or depth:
        up = opened < size and (depth == 0 or rng.random() < deep)
        bits.append(int(up))
        depth += 1 if up else -1
        opened += up
    stack, match = [], {}
    for at, bit in enumerate(bits):
        if bit:
            stack.append(at)
        else:
            match[stack.pop()] = at
    trie = Parentheses(np.array(bits))
    opens = trie.opens()
    assert trie.find_close(opens).tolist() == [match[at] for at in opens.tolist()]
    pairs = [bits[:at + 1].count(1) for at in range(len(bits))]
    assert trie.rank(np.arange(len(bits))).tolist() == [0, *pairs[:-1]]


def trie_rows(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda y: y[:2])] for c, x in own.items()}
    whole = {}
    for conv in turns:
        h = zlib.crc32(str(conv).encode()) % 9
        whole[conv] = turns.get(conv - conv % 5, [])[:h] + turns[conv][h:]
    members = defaultdict(list)
    for conv, path in whole.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(conv)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for path, convs in members.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1].encode()) if path else 0
            leaves[path[:d]] += not children[path]
    found = Counter()
    for path, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(whole[c]) == len(path))))
        found[min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs),
              children[path], leaves[path], saved[path],
              hashlib.sha256(ends.encode()).hexdigest()] += 1
    return found


@pytest.fixture(scope="module")
def turn_rows():
    rng = random.Random(3)
    rows = [(c, t, rng.choice("ua"), rng.choice(["a", "b", "é"]) * rng.choice([1, 1, 2]))
            for c in [*range(40), *range(60, 75)]
            for t in range(rng.choice([1, 2, 3, 5, 8, 12, 20]))]
    rows += [(c, t, "u", "same") for c in range(100, 160) for t in range(4)]
    rows += [(7, None, None, None), (8, 99, "z", None), (9, 50, "u", "é" * 4000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{"shard_turns": 1}, {"band": 7, "shard_turns": 5}], ids=str)
def test_trie_matches_brute_force(shipped, turn_rows, options):
    frame = shipped.createDataFrame(turn_rows, TURNS)
    assert rows_of(conversation_trie.rebuilt_trie(frame, **options)) == trie_rows(turn_rows)


def test_trie_of_odd_tables(shipped, turn_rows):
    assert not rows_of(conversation_trie.rebuilt_trie(shipped.createDataFrame([], TURNS)))
    rows = [*turn_rows, (None, 1, "u", "of none")]
    clashing = shipped.createDataFrame(
        [(*r, 1, 2, 3) for r in rows], TURNS + ", conv long, pos long, k1 long")
    assert rows_of(conversation_trie.rebuilt_trie(clashing)) == trie_rows(rows)


def test_trie_of_one_long_conversation(shipped):
    rows = [(0, t, "u", f"t{t % 7}") for t in range(600)] + [(10, t, "u", f"t{t % 7}")
                                                             for t in range(400)]
    frame = shipped.createDataFrame(rows, TURNS)
    assert rows_of(conversation_trie.rebuilt_trie(frame, shard_turns=300)) == trie_rows(rows)


def shingle_set(text):
    words = SPACE_WORD.findall(lower(text))
    return frozenset(tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3))) \
        if words else frozenset()


def join_rows(docs):
    sets = [(i, shingle_set(t)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        common = Counter()
        for gram in s:
            common.update(holders[gram])
            holders[gram].append(k)
        for other, n in common.items():
            if 100 * n >= 85 * (len(s) + len(sets[other][1]) - n):
                root[find(k)] = find(other)
    least = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return Counter((i, len(s), least.get(find(k))) for k, (i, s) in enumerate(sets))


@pytest.fixture(scope="module")
def families():
    """Groups of texts that differ by some words, so that links chain around the threshold."""
    rng = random.Random(5)
    common = " ".join(f"shared{i}" for i in range(60))
    docs = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(rng.choice([20, 80, 150]))]
        for _ in range(rng.choice([3, 30])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(words) + (" " + common if family % 2 else "")))
    docs += [(len(docs) + k, common + f" own{k}") for k in range(5)]
    return docs


@pytest.mark.parametrize("options", [
    {"frequent": 1.1}, {"chunk_rows": 5, "homes": 1}], ids=str)
def test_join_matches_brute_force(shipped, families, options):
    frame = shipped.createDataFrame(families, "doc_id long, text string").repartition(3)
    found = ngram_join.ngram_components(frame, **options)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert rows_of(found) == join_rows(families)


@pytest.mark.parametrize("table", ["documents", "clashing", "none"])
def test_join_on_odd_tables(table, request):
    docs = request.getfixturevalue(table)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(ngram_join.ngram_components(docs)) == join_rows(rows)


def search_rows(docs, items, top=10):
    terms = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in terms)
    total = sum(sum(c.values()) for _, c in terms)
    df = Counter(w for _, c in terms for w in c)
    found = []
    for item, text in items:
        scored = []
        wanted = Counter(TERM.findall(lower(text)))
        for doc, c in terms:
            n = sum(c.values())
            score = 0
            for w, times in wanted.items():
                if w in c:
                    m = 25 + 75 * n * n_docs // total
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    score += times * weight * (10**9 * c[w] // (1000 * c[w] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc))
        found += [(item, rank, doc, -score)
                  for rank, (score, _, doc) in enumerate(sorted(scored)[:top], 1)]
    return Counter(found)


@pytest.fixture
def small_shards(monkeypatch):
    """Few rows a range and a shard, so that bounds reject rows, blocks and lists."""
    monkeypatch.setattr(ranked_search, "WINDOW_RANGES", 1)
    monkeypatch.setattr(ranked_search, "SHARD_ROWS", 64)


@pytest.mark.parametrize("table", ["documents", "clashing", "none"])
def test_search_matches_brute_force(table, benchmark_items, request):
    docs = request.getfixturevalue(table)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    asked = [(str(r.item_id), r.text) for r in benchmark_items.collect()]
    asked += [("silver", "the SILVER leaves, silver the"), ("none", None), ("none", "   "),
              ("many", "1 2 a w5 w6 silver"), ("many", "1 2 a w5 w6 silver"), (None, "wall")]
    items = docs.sparkSession.createDataFrame(asked, "item_id string, text string")
    found = ranked_search.ranked(docs, items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(found) == search_rows(rows, asked)


def test_search_keeps_ties_and_rejected_rows_right(shipped, small_shards):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(60)]
    docs = [(k, " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(60)],
                                     k=rng.choice([3, 10, 10, 40])))) for k in range(3000)]
    docs += [(5000 - k, "v1 v2 v59 v59") for k in range(30)] + [(9000, "v3 " * 300 + "v59")]
    asked = [(f"q{k}", " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 12]))))
             for k in range(40)] + [("tie", "v59 v59"), ("long", "v3 v0")]
    frame = shipped.createDataFrame(docs, "doc_id long, text string").repartition(2)
    items = shipped.createDataFrame(asked, "item_id string, text string")
    assert rows_of(ranked_search.ranked(frame, items, block_bytes=600)) == search_rows(docs, asked)


def test_search_rejects_blocks_unread(monkeypatch):
    """Common terms are read in the blocks of rows that may still enter only."""
    rng, read = np.random.default_rng(2), []
    n = 20_000
    rows = np.concatenate([np.arange(n), np.sort(rng.choice(n, 60, replace=False))])
    terms = np.concatenate([np.full(n, 7), np.full(60, 9)]).astype(np.uint64)
    order = np.argsort(rows, kind="stable")
    shard = ranked_search.Shard.build(np.arange(n), terms[order], rows[order])
    packed = shard.packed() | {"ids": shard.ids.astype("<i8").tobytes() + bytes(n)}
    searcher = ranked_search.Searcher(packed, np.array([7, 9], np.uint64), np.array([1, 5000]),
                                      ranked_search.Measure(n, n + 60))
    whole = ranked_search.Shard.postings
    monkeypatch.setattr(ranked_search.Shard, "postings",
                        lambda self, blocks: read.append(len(blocks)) or whole(self, blocks))
    best = ranked_search.Best(10)
    searcher.search((np.array([0, 1]), np.array([1, 1])), best)
    assert len(best.heap) == 10 and sum(read) < len(shard.block_range)
