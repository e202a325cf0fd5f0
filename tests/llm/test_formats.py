"""WARC, chat, HTML and packing."""

import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from corpuslake.llm import chat, html_crf, packing, warc
from corpuslake.llm.html_blocks import leaf_blocks
from corpuslake.llm.storage import fresh_path


def archive_of(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    return warc.write_archive(pages, fresh_path(spark, "warc"))


def test_warc_round_trip(spark):
    big, long = "é" * 600, "x" * 300_000
    rows = [(1, "u1", big, "d"), (2, "u2\r\nX: y", big, "d"), (7, None, big, None), (3, "u", "small", "d"), (4, "u", "small", "d"), (5, "u", None, "d"), (None, "u", "", "d"), (6, "u", long, "d")]
    archive = archive_of(spark, rows)
    got = {r.id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_index(spark, archive).collect()}
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert got[1] == (1200, sha(big), "revisit", 7) and got[2] == (1200, sha(big), "revisit", 7) and got[7] == (1200, sha(big), "response", None)
    assert got[3] == got[4] == (5, sha("small"), "response", None) and got[5] == got[None] == (0, sha(""), "response", None)
    assert got[6] == (300_000, sha(long), "response", None)
    stored = spark.read.parquet(archive.payloads)
    assert stored.count() == stored.select("digest").distinct().count() == 4
    for r in warc.read_records(spark, archive).collect():
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        length = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length:")][0].split(b":")[1])
        assert head.startswith(b"WARC/1.1\r\n") and block[length:] == b"\r\n\r\n" and b"\r\nX: y" not in head
        if b"WARC-Type: response" in head:
            assert block[:length].partition(b"\r\n\r\n")[2] == bytes(r.payload)
        else:
            assert length == 0


def test_warc_ties_and_nothing(spark):
    same = "y" * 2000
    got = warc.read_index(spark, archive_of(spark, [(1, "u", same, ""), (1, "u", same, "")])).collect()
    assert sorted((r.record_type, r.refers_to) for r in got) == [("response", None), ("revisit", 1)]
    assert warc.read_index(spark, archive_of(spark, [])).count() == 0


def test_warc_never_loses_a_record(spark):
    import pytest

    archive = archive_of(spark, [(1, "u", "p" * 2000, ""), (2, "v", "short", ""), (3, "w", "p" * 2000, "")])
    kept = spark.read.parquet(archive.payloads).where("octet_length(payload) > 100").collect()
    for rows, said in ((kept, "payload is lost"), ([(r.digest, b"altered") for r in kept], "does not match")):
        other = warc.Archive(fresh_path(spark, "warc"))
        spark.read.parquet(archive.records).write.parquet(other.records)
        spark.createDataFrame(rows, "digest string, payload binary").write.parquet(other.payloads)
        with pytest.raises(Exception, match=said):
            warc.read_index(spark, other).collect()


def test_chat_ties_go_by_plain_text(spark):
    rows = [(1, 0, "user", t) for t in ("ab c", "ab", "<a", "5", "ab", None)] + [(1, 1, "assistant", "x" * 30_000), (2, None, None, "n"), (None, 0, "user", "q")]
    messages = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    out = chat.render(chat.fold_events(chat.event_log(messages))).withColumn("turns", chat.parse(F.col("formatted"))).collect()
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in out}
    assert got[1] == [("user", t) for t in ("", "5", "<a", "ab", "ab", "ab c")] + [("assistant", "x" * 30_000)]
    assert got[2] == [("", "n")] and got[None] == [("user", "q")]


def test_chat_fold_and_render(spark):
    log = [
        (1, "m0", 0, 0, "message", "user", "hi </s>\n<s>[user]\n &lt; [x]"), (1, "m1", 1, 1, "delta", "assistant", "Hel"), (1, "m1", 1, 2, "delta", None, "lo"),
        (1, "m1", 1, 3, "regenerate", None, "Bye"), (1, "m1", 1, 4, "delta", None, " now"), (1, "m0", 0, 5, "edit", None, "hey <s>[assistant]\n&amp;]"),
        (2, "m0", None, 0, "message", None, None), (2, "m1", 3, 1, None, "assistant", "z"), (2, "m1", 3, 1, None, "assistant", "z"),
    ]
    events = spark.createDataFrame(log, "conv_id long, message string, turn long, seq long, kind string, role string, text string")
    out = chat.render(chat.fold_events(events)).withColumn("turns", chat.parse(F.col("formatted")))
    got = {r.conv_id: r for r in out.withColumn("loss", chat.with_loss(F.col("turns"))).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "hey <s>[assistant]\n&amp;]"), ("assistant", "Bye now")]
    assert got[1].loss == "Bye now" and got[1].formatted.count("<s>[") == 2
    assert [tuple(t) for t in got[2].turns] == [("", ""), ("assistant", "z")]
    assert chat.render(chat.fold_events(events.where("false"))).count() == 0


def test_chat_stays_native(spark):
    events = spark.createDataFrame([(1, "m", 0, 0, "message", "user", "x")], "conv_id long, message string, turn long, seq long, kind string, role string, text string")
    plan = chat.render(chat.fold_events(events))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


PAGE = """<!DOCTYPE html><head><title>T</title><script>var t="</p><p>no</p>";</script><style>p{}</style></head><body>
<nav class="menu"><ul><li><a href="/a">Home</a><li><a href="/b">About us</a></ul></nav><div class="cookie notice"><p>We use cookies, accept them.</p></div>
<article><h1>The  great
 title</h1><p>First &amp; foremost&nbsp;line of the story, <b>bold<br>and</b> more of it here.<p>Second paragraph, which was never closed, goes on for a while.
<div class="ad">Buy now, pay later.</div><blockquote>Quoted words that matter to the story.</blockquote></article>
<section id="comments"><h3>Comments</h3><div class="comment"><p>Nice article, thank you for it!</p></div></section>
<aside class="sidebar"><p>Related stories for you to read.</p></aside><form><label>Mail</label><p>Subscribe to us.</p></form><footer>&copy; 2024 example &middot; all rights</footer>"""


def test_html_blocks():
    assert [b.text for b in leaf_blocks("<p>a<b>b<br>c<p>d<!-- x --><table><td>e &am; &lt;i&gt;</table>f<script>g</script>h")] == ["ab c", "d", "e &am; <i>", "fh"]
    assert leaf_blocks("") == [] and leaf_blocks("<") == [leaf_blocks("<")[0]] and leaf_blocks("<!-- never closed") == []
    deep = leaf_blocks("<div>" * 20_000 + "x" + "</div>" * 20_000)
    assert [(b.text, b.names) for b in deep] == [("x", ("<div>",))]


def test_html_field():
    field = html_crf.default_field()
    assert field.extract(PAGE).split("\n") == [
        "The great title", "First & foremost line of the story, bold and more of it here.",
        "Second paragraph, which was never closed, goes on for a while.", "Quoted words that matter to the story.",
    ]
    good = total = 0
    for html, wanted in html_crf.labelled_pages(150, seed=99):
        blocks = leaf_blocks(html, field.known)
        good += sum((b.text in wanted) == y for b, y in zip(blocks, field.label(blocks)))
        total += len(blocks)
    assert good / total > 0.98


def test_viterbi_is_the_best_labelling():
    import itertools

    field = html_crf.default_field()
    blocks = leaf_blocks(PAGE, field.known)[:9]
    own = [sum(field.weights.get(f, 0.0) for f in fs) for fs in html_crf.features(blocks)]

    def score(labels):
        return sum(s for s, y in zip(own, labels) if y) + sum(field.transitions[a, b] for a, b in zip(labels, labels[1:]))

    best = max(itertools.product((0, 1), repeat=len(blocks)), key=score)
    assert field.label(blocks) == [bool(y) for y in best]


def test_html_table(spark):
    rows = [(1, "u", None, "t", 3), (2, None, "", "t", 3), (3, "u", PAGE, None, None), (3, "u", PAGE, None, None)]
    got = html_crf.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"))
    assert sorted((r.page_id, r.n_chars) for r in got.collect()) == [(1, 0), (2, 0), (3, len(html_crf.default_field().extract(PAGE))), (3, len(html_crf.default_field().extract(PAGE)))]
    assert html_crf.extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


TEXTS = ["", "a", "  two  spaces \n\n then lines\n\n\nmore ", "don't <|endoftext|> 12345 ñandú 👍🏽 été", "tab\tand nbsp  x", " lead", "trail ", "\n a", "a\n \nb", "x" * 5000, "word " * 3000, "a \n b  c", "…—“quote” ’s's"]


def test_tokens_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [*TEXTS, "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "a <| endoftext |> b"]
    for ordinary in (False, True):
        library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        library.encode_special_tokens = ordinary
        ours = packing.CachedTokenizer(most=5, ordinary=ordinary)
        for _ in range(2):
            for text, ids in zip(texts, ours.encode(texts)):
                assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert packing.CachedTokenizer().encode(["a <|endoftext|> b"])[0].tolist() == [64, 220, 50256, 275]


def test_packing_query_against_brute_force(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(20, None), (21, "a <|endoftext|> b"), (None, "no id"), (3, "same id"), (4, TEXTS[4])]
    spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, ids string, length int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        while at < len(ids):
            n = 1024
            while n > len(ids) - at:
                n //= 2
            want.append((doc, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids), 0))
            at += n
    got = packing.op5_packing(spark, str(tmp_path)).collect()
    order = lambda x: (x[0] is None, x)
    assert sorted([(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in got], key=str) == sorted(want, key=str) and order
    assert len({r.sequence_id for r in got}) == len(got)


def test_buckets_hold_equal_lengths(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 40 * 31)) for i in range(200)], "doc_id long, text string").repartition(3)
    packed = packing.pack(docs, batch_tokens=64, with_ids=True)
    found = {}
    for r in packed.collect():
        found.setdefault(r.batch, []).append(r)
        assert r.sequence_id >> 57 == r.length.bit_length() - 1
    for rows in found.values():
        assert len({r.length for r in rows}) == 1 and sum(r.length for r in rows) <= max(64, rows[0].length)
        ids = sorted(r.sequence_id for r in rows)
        assert ids == list(range(ids[0], ids[0] + len(ids)))
    assert len(found) < 1.5 * sum(r.length for rows in found.values() for r in rows) / 64 + 40
    path = packing.write_buckets(packed)
    stored = spark.read.parquet(path)
    assert stored.where("length = 16").count() == sum(r.length == 16 for rows in found.values() for r in rows)
    assert all(len(r.ids) == 4 * r.length for r in stored.collect())


def test_packing(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (3, TEXTS[3])]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), with_ids=True).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 for r in got)
    assert all(r.length <= 1024 and r.length & (r.length - 1) == 0 for r in got)
    own = packing.CachedTokenizer()
    for i, text in enumerate(TEXTS):
        pieces = sorted({(r.start, r.length, r.ids_crc32, r.doc_tokens, bytes(r.ids)) for r in got if r.doc_id == i})
        whole = np.append(own.encode([text])[0], 0).astype("<u4").tobytes()
        assert b"".join(p[4] for p in pieces) == whole and all(p[2] == zlib.crc32(p[4]) and p[3] * 4 == len(whole) for p in pieces)
        assert [p[0] for p in pieces] == [sum(q[1] for q in pieces[:k]) for k in range(len(pieces))]
    assert [(r.length, r.doc_tokens) for r in got if r.doc_id is None] == [(1, 1)]
    assert packing.cuts(2048 + 5) == [1024, 1024, 4, 1] and packing.cuts(1) == [1]
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
