"""URL rules, HTML text, WARC bundles, token shards, packing and the pipeline."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tabulyze.llm import html_text, packing, repair, simhash, url_rules, warc
from tabulyze.llm.batches import slices
from tabulyze.llm.queries import ORACLES, QUERIES
from tabulyze.llm.tokens import Encoder

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SMALL}/pages.parquet'")
    relation = con.execute(ORACLES[name])
    names = [d[0] for d in relation.description]
    expected = sorted(map(repr, relation.fetchall()))
    frame = QUERIES[name](spark, SMALL)
    assert sorted(frame.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in frame.select(*names).collect()) == expected


PAGES = [
    (1, None, None), (2, "no scheme/en/", "x"), (3, "HTTP://WWW.Example.COM/en/a?b#c", "y" * 200),
    (4, "http://a.example.com/en/", "y" * 200), (4, "http://a.example.com/en/", "y" * 200),
    (None, "https://x.net/es/casino-win", "y" * 200), (5, "https://x.org/casino-win/1", "é" * 80),
    (6, "https://x.org/casino-winner", "é" * 80), (7, "https://x.org", ""), (8, "", "z" * 99),
    (9, "https://x.org/ads/1/2.html\r\nX: y", "z" * 99),
    (10, "https://notexample.com/en/", "z" * 300_000),
    (11, "https://x.org/free-bets/responsible-gaming", "z" * 300_000),
]


@pytest.fixture(scope="module")
def pages(shipped):
    from pyspark.sql import functions as F

    rows = shipped.createDataFrame(PAGES, "page_id long, url string, html string")
    return rows.select("*", *(F.lit(1).alias(c) for c in ("id", "digest", "rule", "p", "first")))


def test_url_rules_on_odd_urls(pages):
    found = {r.page_id: r for r in url_rules.judged(pages).collect()}
    assert (found[1].host, found[1].path, found[1].verdict) == ("", "", "allow")
    assert (found[2].host, found[2].rule) == ("", None)
    assert (found[3].host, found[3].path, found[3].rule) == (
        "www.example.com", "/en/a", "www.example.com/en/")
    assert (found[4].rule, found[4].verdict) == ("example.com/en/", "block")
    assert (found[None].rule, found[None].verdict) == ("net/es/", "block")
    assert (found[5].pattern, found[5].verdict) == ("casino-win", "block")
    assert (found[6].pattern, found[6].verdict) == (None, "allow")
    assert (found[9].pattern, found[9].verdict) == ("/ads/*.html", "block")
    assert found[10].rule == "com/" and found[7].path == ""
    assert (found[11].pattern, found[11].verdict) == ("responsible-gaming", "allow")
    assert url_rules.judged(pages.limit(0)).count() == 0


def test_only_fetched_patterns_run(pages):
    rules = [url_rules.PatternRule("block", f"word{i}-x") for i in range(50)]
    index = url_rules.indexed(tuple(rules), {"x": 1000})
    tried = pages.select(url_rules.pattern_rule(pages.url, index)["tried"].alias("n"))
    assert tried.agg({"n": "max"}).first()[0] == 0
    assert set(index) == {f"word{i}" for i in range(50)}


def test_html_layout():
    page = ("<head><title>no</title></head><h1>A  b</h1><p>one<p>two <b>bold</b>text"
            "<ul><li>x<li>y<ul><li>deep</ul></ul><ol start=3><li>q<li>r</ol>"
            "<table><caption>cap</caption><tr><td>a<td>bbb<tr><td>cccc<td>d</table>"
            "<div hidden>no</div><p style='display: none'>no</p><pre> k\n  l</pre>z&amp;&lt;<br>w"
            "<script>if (a < b) '</p>'</script><!-- no --><div>d1</div><div>d2")
    assert html_text.page_text(page) == (
        "A b\n\none\n\ntwo boldtext\n\n- x\n- y\n  - deep\n\n3. q\n4. r\n\ncap\n"
        "a    | bbb\ncccc | d\n\n k\n  l\n\nz&<\nw\nd1\nd2")


@pytest.mark.parametrize("page, text", [
    (None, None), ("", ""), ("plain", "plain"), ("a < b > c", "a < b > c"), ("</p></x>", ""),
    ("<td>loose", "loose"), ("<div " * 3 + ">x", "x"), ("<b>" * 3000 + "deep", "deep"),
    ("<script>open", ""), ("<p>a<p>b", "a\n\nb"),
])
def test_html_odd_pages(page, text):
    assert html_text.page_text(page) == text


def test_html_table_and_empty(pages):
    assert html_text.extracted(pages).count() == len(PAGES)
    assert html_text.extracted(pages.limit(0)).collect() == []


def test_warc_round_trip(pages):
    index = warc.write_bundles(pages)
    rows = sorted(map(tuple, warc.read_bundles(index).collect()), key=str)
    expected = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == data and p is not None]
        first = min(same) if len(data) >= 100 else page
        revisit = page != first
        expected.append((page, len(data), hashlib.sha256(data).hexdigest(),
                         "revisit" if revisit else "response", first if revisit else None))
    assert rows == sorted(expected, key=str)
    for r in index.collect():
        record = warc.read_record(r.path, r.frame, r.offset, r.length)
        assert record.headers["warc-record-id"] == r.record_id
        assert "x" not in record.headers
    assert warc.archived(pages.limit(0)).count() == 0


def expected_ids(definition, text):
    tokenizer = Tokenizer.from_str(definition)
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


@pytest.mark.parametrize("text", [
    "a\n\n  b\t\tc \n d", " lead", "trail  ", "it's 's 'll re'd don't!'s 12ab,34.cd é5 5é\x1c x\x1fy",
    " x  y　z", "<|endoftext|>\n\n<|endoftext|>x", "x" * 600, "a  <b> ...  !!!  é ü",
    "\r\n\r\nA\r\n", "\U0001f600 \U0001f600\U0001f600 a\U0001f600b", " \n", "\n \n", "….— “q” ’s",
])
def test_chunked_encoding_is_the_tokenizers(definition, text):
    import pyarrow as pa

    encoder = Encoder(definition)
    assert encoder.chunked
    for part in slices(pa.array([text, None, text + text, "", " " + text])):
        ids, counts = encoder.encode(part)
        got = np.split(ids, np.cumsum(counts)[:-1])
        for one, data in zip(got, part.texts):
            assert one.tolist() == expected_ids(definition, data.decode())[:-1].tolist()


def test_full_chunk_table_starts_anew(definition, monkeypatch):
    import pyarrow as pa

    encoder = Encoder(definition)
    monkeypatch.setattr(type(encoder.table), "full", lambda self, more: self.n > 0)
    for text in ("one two three", "four five one", "one two six"):
        for part in slices(pa.array([text])):
            assert encoder.encode(part)[0].tolist() == \
                expected_ids(definition, text)[:-1].tolist()


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.geometric(0.1, 50_000), 400).astype("<u4")
    ids[1000:4000] = 5
    bounds = np.array([0, 0, 1, 1000, 4000, 4000, 30_000, 50_000])
    data = b"".join(repair.shard_bytes([None, 1, 2, 2, 3, 4, 5], ids, bounds))
    shard = repair.Shard.parse(data)
    back, again = shard.ids()
    assert (back == ids).all() and (again == bounds).all()
    assert len(shard.grammar.pairs) > 100 and len(shard.symbols) < 0.7 * len(ids)
    for doc in range(7):
        own = ids[bounds[doc]:bounds[doc + 1]]
        for a, b in ((0, len(own)), (len(own) // 3, len(own) // 2), (len(own) - 1, len(own) + 9)):
            if 0 <= a < b:
                assert shard.span(doc, a, b).tolist() == own[a:b].tolist()


@pytest.mark.parametrize("seed", range(40))
def test_grammars_leave_no_pair_that_pays(seed):
    draw = np.random.default_rng(seed)
    ids = draw.integers(0, draw.integers(1, 6), draw.integers(0, 400)).astype(np.uint32)
    ids = np.concatenate([ids, np.tile(ids[:60], draw.integers(0, 5))])
    cuts = np.sort(draw.integers(0, len(ids) + 1, 3))
    bounds = np.concatenate(([0], cuts, [len(ids)]))
    shard = repair.Shard.parse(b"".join(repair.shard_bytes([1, 2, 3, 4], ids, bounds)))
    back, again = shard.ids()
    assert (back == ids).all() and (again == bounds).all()
    lengths = [1] * shard.grammar.base
    for (a, b), n in zip(shard.grammar.pairs.tolist(), shard.grammar.lengths.tolist()):
        lengths.append(lengths[a] + lengths[b])
        assert lengths[-1] == n
    uses = {}
    for a, b in zip(shard.begins, [*shard.begins[1:], len(shard.symbols)]):
        before, taken = None, False
        for pair in zip(shard.symbols[a:b - 1].tolist(), shard.symbols[a + 1:b].tolist()):
            taken = pair == before and pair[0] == pair[1] and not taken
            uses[pair] = uses.get(pair, 0) + (not taken)
            before = pair
    assert max(uses.values(), default=0) < repair.LEAST_USES


def test_grammars_grow_as_far_as_texts_repeat():
    draw = np.random.default_rng(7)
    passage = draw.integers(0, 60_000, 1000).astype(np.uint32)
    ids = np.concatenate([np.append(passage, draw.integers(0, 60_000, 50)) for _ in range(100)])
    ids = ids.astype(np.uint32)
    data = b"".join(repair.shard_bytes([1], ids, np.array([0, len(ids)])))
    shard = repair.Shard.parse(data)
    assert shard.grammar.lengths.max() >= 1000 and len(shard.symbols) <= 51 * 100
    assert (shard.ids()[0] == ids).all()
    assert shard.span(0, 50_123, 53_000).tolist() == ids[50_123:53_000].tolist()


def test_symbols_beyond_sixteen_bits():
    ids = np.tile(np.arange(3 * (1 << 17), dtype=np.uint32)[::7], 3)
    bounds = np.array([0, len(ids) // 3, len(ids)])
    shard = repair.Shard.parse(b"".join(repair.shard_bytes([1, 2], ids, bounds)))
    assert (shard.ids()[0] == ids).all() and shard.grammar.base > 1 << 18


@pytest.mark.parametrize("numbers", [[], [0], [127, 128, 1 << 14, (1 << 32) - 1, 0, (1 << 35) - 1]])
def test_packed_numbers_come_back(numbers):
    data = np.frombuffer(repair.packed_numbers(np.array(numbers, np.int64)), np.uint8)
    assert repair.unpacked_numbers(data).tolist() == numbers


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("table", ["documents", "odd", "clashing", "none"])
def test_token_shards(table, request, definition):
    docs = request.getfixturevalue(table)
    found = ordered(map(tuple, repair.token_shards(docs, definition).collect()))
    rows = [(r.doc_id, expected_ids(definition, r.text)) for r in
            docs.select("doc_id", "text").collect()]
    assert sorted((str(i), n, c) for i, _, n, c in found) == sorted(
        (str(i), len(x), zlib.crc32(x.tobytes())) for i, x in rows)
    at = 0
    for _, start, n, _ in sorted(found, key=lambda r: r[1]):
        assert start == at
        at += n
    by_start = [r[0] for r in sorted(found, key=lambda r: r[1])]
    assert by_start == [r[0] for r in ordered(found)]


@pytest.mark.parametrize("table, capacity", [
    ("documents", 2048), ("documents", 100), ("odd", 2048), ("clashing", 64), ("none", 2048)])
def test_packing_holds_every_piece(table, capacity, request, definition):
    docs = request.getfixturevalue(table)
    rows = packing.packed(docs, definition, capacity=capacity).collect()
    sequences, pieces = {}, []
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.append((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    expected = []
    for doc in docs.select("doc_id", "text").collect():
        ids = expected_ids(definition, doc.text)
        head, at, piece = (len(ids) - 1) % capacity + 1, 0, 0
        while at < len(ids):
            part = ids[at:at + (capacity if piece else head)]
            expected.append((str(doc.doc_id), piece, at, len(part), zlib.crc32(part.tobytes())))
            at, piece = at + len(part), piece + 1
    assert sorted(pieces) == sorted(expected)
    least = -(-sum(p[3] for p in pieces) // capacity)
    assert len(sequences) <= 1.05 * least + 2


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(2)
    lengths = np.clip(rng.lognormal(6, 1.2, 30_000).astype(int), 1, 2048)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    runs = packing.plan(histogram)
    assert sum(r.n for r in runs) <= 1.02 * -(-int(lengths.sum()) // 2048)
    table = packing.slots(runs)
    used = {}
    for length, low, copies, first in zip(table["length"], table["low"], table["copies"],
                                          table["first"]):
        run = next(r for r in runs if r.first == first)
        used[int(length)] = used.get(int(length), 0) + int(copies) * run.n
    assert used == histogram


def test_pipeline_stages(shipped, odd, clashing, none):
    for docs in (odd, clashing, none):
        left = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(shipped, left, SMALL)
            assert out.columns == docs.columns, name
            assert out.count() <= left.count()
            left = out
        packed = corpus_pipeline.STAGES[-1][1](shipped, left, SMALL)
        assert sorted({str(r.doc_id) for r in packed.collect()}) == sorted(
            {str(r.doc_id) for r in left.select("doc_id").collect()})


def test_near_copies_leave_the_smallest_id(shipped, odd):
    kept = corpus_pipeline.keep_one_of_near_copies(shipped, odd, SMALL).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(4) == 1 and None not in ids and 1 in ids and 2 not in ids


@pytest.mark.parametrize("page, text", [
    ("<head><title>T</title><p>Hello <b>you</b>", "Hello you"),
    ("<html><head><meta charset=x>bare text<div>more</div>", "bare text\nmore"),
    ("<head><title>T</title></head><body><p>a", "a"),
    ("<table><colgroup><col><tr><td>A<td>B<tr><td>C</table>z", "A | B\nC\n\nz"),
    ("<table><caption>Cap<tr><td>A</table>", "Cap\nA"),
    ("<table><colgroup><col><tbody><tr><td>A</table>", "A"),
    ("<table><tbody>loose<tr><td>A</td></tr></tbody></table>", "loose\nA"),
    ("<table><tbody><form><tr><td>A<td>B</td></tr></form></tbody></table>", "A | B"),
    ("<table><tr><form><td>A</td></form></tr></table>", "A"),
    ("<table><thead><div>d<tr><td>A</table>", "d\nA"),
    ("<table><tr><td><table><tr><td>in</table><td>out</table>", "in | out"),
])
def test_ends_left_out_lose_no_text(page, text):
    assert html_text.page_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<p title=it's>one</p><p>don't</p>", "one\n\ndon't"),
    ('<img alt="5" screen">seen<p class="x">more</p>', "seen\n\nmore"),
    ("<p title=\"a > b\">in</p><a href='x>y'>link</a>", "in\n\nlink"),
    ('<a href=x?a="b>c</a>"', 'c"'),
    ('<p title="never closed>shown</p>', "shown"),
    ("<p style='display:none'>no</p><p title=it's style=display:none>no</p><p>yes</p>", "yes"),
    ('<span aria-hidden="true">drawn</span>', "drawn"),
    ("a<xmp><b>  x &amp; y</b>\nz</xmp>b", "a\n\n<b>  x &amp; y</b>\nz\n\nb"),
])
def test_quotes_and_drawn_elements_hide_no_text(page, text):
    assert html_text.page_text(page) == text


def test_many_attributes_of_an_open_tag_are_read_once():
    page = "<p " + 'a="b" ' * 5000
    assert html_text.page_text(page + ">x") == "x"
    assert "a=" in html_text.page_text(page)


def test_one_of_each_component_stays(shipped, documents):
    """The stage keeps, of each component that the operator finds, the row with the least id."""
    kept = corpus_pipeline.keep_one_of_near_copies(shipped, documents, SMALL)
    found = simhash.simhash_components(documents).select("component_id").distinct()
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in found.collect())
