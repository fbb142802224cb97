"""Layout of HTML pages beyond the plain cases, and the exchange of words against plain Python."""

import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tabulyze.llm import html_text, word_exchange


@pytest.mark.parametrize("page, text", [
    # Spans keep later cells in their columns.
    ("<table><tr><td colspan=2>Wide<td>C<tr><td>1<td>2<td>3</table>", "Wide  | C\n1 | 2 | 3"),
    ("<table><tr><td rowspan=2>A<td>B<tr><td>C<tr><td>D<td>E</table>", "A | B\n  | C\nD | E"),
    ("<table><tr><td rowspan=0>A<td>B<tr><td>C<tr><td>D</table>", "A | B\n  | C\n  | D"),
    ("<table><tr><td>a<td>b<tr><td colspan=2>much wider</table>", "a | b\nmuch wider"),
    ("<table><tr><td colspan=x>a<td colspan=-2>b<td rowspan='1'>c</table>", "a | b | c"),
    ("<table><tr><td colspan=1000000>a<td>b<tr><td>c</table>", "a | b\nc"),
    # Visibility is inherited and can be turned on again; display cannot.
    ("<p style='visibility:hidden'>no <b style='visibility:visible'>yes</b> no</p>", "yes"),
    ("<p style='display:none'>no <b style='visibility:visible'>no</b></p>x", "x"),
    ("<div style='display&#58;none'>no</div>x", "x"),
    ("<table style='visibility:hidden'><tr><td>a<td style='visibility:visible'>b</table>",
     "| b"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("<details>no<summary>head</summary>no</details>x", "head\nx"),
    ("<details open><summary>head</summary>body</details>", "head\nbody"),
    # Numbers of lists, and the first line end of pre.
    ("<ol start=-1><li>a<li>b<li value=7>c<li>d</ol>", "-1. a\n0. b\n7. c\n8. d"),
    ("<pre>\na\n  b</pre>", "a\n  b"),
    ("a <b x='1", "a <b x='1"),
    ("a <b>c</b> <i <u", "a c <i <u"),
])
def test_html_spans_visibility_and_lists(page, text):
    assert html_text.page_text(page).strip(" ") == text


@pytest.mark.parametrize("page", [
    "<a " * 400_000, "</b" * 400_000, "<a x=1 " * 150_000, "<" * 1_000_000, "<!--" * 200_000,
    "<b>" * 100_000 + "<p>x" * 50_000, "<div>" * 100_000 + "</p>" * 100_000,
    "<b>" * 100_000 + "</i>" * 100_000, "<textarea>" * 50_000, "a &" * 300_000,
])
def test_html_hostile_pages_take_linear_time(page):
    begin = time.process_time()
    assert html_text.page_text(page) is not None
    assert time.process_time() - begin < 10


def test_html_has_no_depth_limit():
    for tag in ("div", "b", "table><tr><td", "ul><li"):
        page = f"<{tag}>" * 600 + "<div hidden>secret</div>shown"
        text = html_text.page_text(page)
        assert "shown" in text and "secret" not in text


def plain_turn(texts, core, rare, follow, sizes, classes):
    """Likeliest classes of all words, and the class pairs, in plain Python."""
    label = {**core, **rare}
    contexts, pairs = defaultdict(Counter), Counter()
    for words in texts:
        line = [None, *words, None]
        for a, b in zip(line, line[1:]):
            contexts[b][0, label[a]] += 1
            contexts[a][1, label[b]] += 1
            pairs[label[a], label[b]] += 1
    new = {}
    for w, k in label.items():
        def gain(c):
            left = sum(n * follow[x, c] for (s, x), n in contexts[w].items() if s == 0)
            right = sum(n * follow[c, x] for (s, x), n in contexts[w].items() if s == 1)
            uses = sum(n for (s, _), n in contexts[w].items() if s == 0)
            return left + right - uses * np.log(sizes[c] + 1.0)
        new[w] = max(range(classes), key=gain) if w is not None else k
        if w is not None and gain(new[w]) <= gain(k) + 1e-9:
            new[w] = k
    return new, pairs


@pytest.mark.parametrize("core_size, buckets", [(0, 1), (5, 1), (5, 7), (40, 3)])
def test_a_turn_of_the_exchange_equals_plain_python(shipped, core_size, buckets):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [[vocabulary[min(int(x), 59)] for x in rng.zipf(1.3, rng.integers(0, 30))]
             for _ in range(60)]
    docs = shipped.createDataFrame([(" ".join(t),) for t in texts], "text string").repartition(3)
    counts = Counter(w for t in texts for w in t)
    part = next(word_exchange.slices(pa.array(list(counts))))
    hashes, shapes, _ = word_exchange.shaped_words(part, 8)
    names = [t.decode() for t in part.texts]
    hash_of, shape_of = dict(zip(names, hashes)), dict(zip(names, shapes))
    frequent = [w for w, _ in counts.most_common(core_size)]
    known = np.sort(np.array([hash_of[w] for w in frequent], np.uint64))
    of_shape = np.arange(8) % 4
    place = {w: int(np.searchsorted(known, hash_of[w])) for w in frequent}
    core = np.append(np.arange(len(known)) % 4, 4)
    label = {w: int(core[place[w]]) for w in frequent} | {None: 4}
    rare = {w: int(of_shape[shape_of[w]]) for w in counts if w not in label}

    linked = word_exchange.portions(docs, known, 8, buckets)
    turn_rows = word_exchange.rare_files(linked, of_shape, 4, buckets)
    start = np.ones((5, 5)) + np.arange(25).reshape(5, 5) % 7
    # No sweep settles a model that moves no word: one sweep, then the count.
    found, words, pairs = word_exchange.exchange_words(
        linked, turn_rows, core, start, len(counts), 4, buckets, few_moves=1e9, least_rise=0.0)

    def follow(p):
        return np.log((p + 0.5) / (p.sum(axis=1, keepdims=True) + 0.5 * 5))

    now = start
    for half in (0, 1):
        new, counted = plain_turn(texts, label, rare, follow(now), now.sum(axis=0), 4)
        turn = word_exchange.Turn(4, half, core, follow(now), now.sum(axis=0))
        core_moves = turn.moves(np.arange(len(known)))
        for w in frequent:
            label[w] = new[w] if core_moves[place[w]] else label[w]
        for w in rare:
            moves = turn.moves(np.array([hash_of[w]], np.uint64).view(np.int64))[0]
            rare[w] = new[w] if moves else rare[w]
        now = np.zeros((5, 5))
        for (a, b), n in counted.items():
            now[a, b] = n
    _, counted = plain_turn(texts, label, rare, follow(now), now.sum(axis=0), 4)
    assert {w: int(found[place[w]]) for w in frequent} == {w: label[w] for w in frequent}
    got = {r.h: (r.c, r.k, r["shape"]) for r in words.collect()}
    assert got == {int(np.uint64(hash_of[w]).astype(np.int64)): (counts[w], k, shape_of[w])
                   for w, k in rare.items()}
    # Every text begins after an end token; plain lines begin with one each as well.
    assert {(a, b): int(n) for (a, b), n in np.ndenumerate(pairs) if n} == dict(counted)
