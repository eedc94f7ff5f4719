from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from awkward_tables import awkward, documents, empty  # noqa: F401
from tagtide.llm import bytepairs, packing, pieces, tokencount

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def test_edits_give_the_counts_of_the_edited_text(documents):
    encode, split, count = bytepairs.encoding(RANKS).encode_ordinary, bytepairs.splitter(), bytepairs.counts(RANKS)
    rnd = random.Random(5)
    parts = [" ", "  ", "\n", "'s", "'", "a", "!", "9", "é", "漢字", " the quick", "\t\t", "x" * 30]
    for text in [d["text"] or "" for d in documents if len(d["text"] or "") < 4_000] + ["x\n\n\n y  z", "\r\n " * 40]:
        tree = tokencount.PreTokenTree(*tokencount.grown(text, split, count))
        for _ in range(15):
            at = rnd.randint(0, len(text) + 2)
            edit = (at, rnd.choice([0, 0, 1, 2, 5, 40, 400]), "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 4))))
            at = min(at, len(text))
            expected = text[:at] + edit[2] + text[at + edit[1] :]
            text, _ = tree.edit(text, edit, split, count)
            assert text == expected
            assert tree.pre_tokens()[0].tolist() == [len(p) for p in split.findall(text)]
            assert tree.n_tokens == len(encode(text))


def test_an_edit_encodes_its_surroundings_only():
    split, count = bytepairs.splitter(), bytepairs.counts(RANKS)
    text = " ".join(f"word{i}" for i in range(20_000))
    tree = tokencount.PreTokenTree(*tokencount.grown(text, split, count))
    assert tree.edit(text, (50_000, 3, "new words"), split, count)[1] < 12


def test_edits_in_a_table(spark, awkward, documents, empty):
    edits = spark.createDataFrame(
        [(5, 2, 3, 1, "later"), (5, 1, 0, 0, "First "), (12, 1, None, None, None), (0, 1, 9, 9, "of a null")],
        "doc_id long, seq int, start int, removed int, added string",
    )
    state = tokencount.with_edits(tokencount.count_tokens(awkward, RANKS), edits)
    done = tokencount.apply_edits(state, RANKS)
    assert done.drop("pre_lengths", "pre_tokens", "n_tokens", "n_encoded").schema == awkward.schema
    encode = bytepairs.encoding(RANKS).encode_ordinary
    changed = {0: "of a null", 5: "Firlater" + "First ONE two three"[4:]}
    texts = [(d["doc_id"], changed.get(d["doc_id"], d["text"])) for d in documents]
    expected = Counter((key, text, len(encode(text or ""))) for key, text in texts)
    assert Counter((r.doc_id, r.text, r.n_tokens) for r in done.collect()) == expected
    assert tokencount.count_tokens(empty, RANKS).count() == 0
    with pytest.raises(ValueError, match="n_tokens"):
        tokencount.count_tokens(awkward.withColumn("n_tokens", F.lit(1)), RANKS)


@pytest.mark.parametrize("width", [7, 64])
def test_best_fit_decreasing_fills_as_a_plain_search_does(width):
    rnd = random.Random(width)
    for n in (0, 1, 40, 400):
        sizes = np.array([rnd.randint(1, width) for _ in range(n)], dtype=np.int64)
        rows = packing.best_fit_decreasing(sizes, width)
        room: list[int] = []
        for s in sorted(sizes.tolist(), reverse=True):
            fits = [(r - s, i) for i, r in enumerate(room) if r >= s]
            if fits:
                room[min(fits)[1]] -= s
            else:
                room.append(width - s)
        assert sorted(i for row in rows for i in row) == list(range(n))
        assert sorted(width - int(sizes[row].sum()) for row in rows) == sorted(room)


@pytest.mark.parametrize("lot_bytes", [16 << 20, 20_000])
def test_packed_rows_hold_all_texts(awkward, documents, empty, lot_bytes):
    rows = packing.pack(awkward, RANKS, width=128, lot_bytes=lot_bytes).collect()
    encoding, found = bytepairs.encoding(RANKS), {}
    for r in rows:
        ids, places = packing.matrix([r.ids], 128)[0], packing.matrix([r.positions], 128)[0]
        assert r.lengths[0] == 0 and r.lengths[-1] == r.used <= 128 and (ids[r.used :] == 50256).all()
        for a, b, doc, part in zip(r.lengths, r.lengths[1:], r.doc_ids, r.parts):
            assert places[a:b].tolist() == list(range(b - a))
            found.setdefault((doc, part), []).append(ids[a:b].tolist())
        assert places[r.used :].tolist() == list(range(128 - r.used))
    expected = {}
    for d in documents:
        made = [*encoding.encode_ordinary(d["text"] or ""), 50256]
        for part, at in enumerate(range(0, len(made), 128)):
            expected.setdefault((d["doc_id"], part), []).append(made[at : at + 128])
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    assert packing.pack(empty, RANKS).count() == 0


def test_packing_does_not_depend_on_partitions(awkward):
    def packed(docs):
        return sorted((r.lot, r.step, r.row, bytes(r.ids), r.parts) for r in packing.pack(docs, RANKS, width=64, lot_bytes=30_000).collect())

    assert packed(awkward) == packed(awkward.repartition(2, "lang"))


def test_pieces_without_dropout_are_those_of_the_library(documents):
    vocab, library = pieces.vocabulary(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in [d["text"] or "" for d in documents] + ["      six", "a" * 300, "é漢字😀", "tab\tnew\nline"]:
        if "▁" not in text and "\0" not in text:
            assert np.frombuffer(vocab.encode(text), "<i4").tolist() == library.encode(text)


def test_short_and_long_agendas_agree():
    vocab, rnd = pieces.vocabulary(PIECES), random.Random(2)
    for _ in range(200):
        run = " " + "".join(rnd.choice("thereationsing") for _ in range(rnd.randint(1, 30)))
        symbols = [vocab.single.get(c, -1 - ord(c)) for c in run]
        for gaps in (pieces.gap_table(0.0), pieces.gap_table(0.4)):
            bits = rnd.getrandbits(64)
            short = vocab._merge_short(list(symbols), pieces.Skips(gaps, bits))
            assert short == vocab._merge_long(list(symbols), pieces.Skips(gaps, bits))


def test_merges_are_skipped_as_often_as_asked_for():
    vocab, rnd = pieces.vocabulary(PIECES), random.Random(3)
    gaps = pieces.gap_table(0.1)
    assert abs(np.mean(gaps) - 9) < 0.1
    runs = [" " + "".join(rnd.choice("thereationsing") for _ in range(7)) for _ in range(4_000)]
    for run, (ids, merges) in vocab.plain(runs).items():
        bits = rnd.getrandbits(64)
        if gaps[bits & 4095] >= merges:
            assert vocab.encode_run(run, pieces.Skips(gaps, bits)) == ids
        assert vocab.encode_run(run) == ids


@pytest.mark.parametrize("skip", [0.0, 0.1, 0.7, 1.0])
def test_dropout_varies_and_decodes(documents, skip):
    vocab = pieces.vocabulary(PIECES)
    text = " ".join(d["text"] for d in documents[:20] if d["text"])
    made = [vocab.encode(text, skip, seed, 4, key) for seed, key in ((1, 1), (1, 1), (2, 1), (1, 2))]
    assert made[0] == made[1] and (len({*made}) == 3) == (0 < skip < 1)
    assert all(vocab.decode(m) == text for m in made)


def test_what_is_kept_changes_nothing(documents, monkeypatch):
    """Also where so little is kept that runs are forgotten between their first and their next use."""
    vocab = pieces.vocabulary(PIECES)
    texts = [d["text"] or "" for d in documents]
    keys = list(range(len(texts)))
    alone = [vocab.encode(t, 0.1, 3, 4, k) for t, k in zip(texts, keys)]
    for limit in (1, 5, 300, 200_000):
        monkeypatch.setattr(pieces.Kept, "limit", limit)
        monkeypatch.setattr(pieces.Kept, "core", limit // 2)
        cores = [{}, {}, {}, {}]
        for _ in range(2):
            kept = pieces.Kept(4, cores)
            assert [m for at in range(0, len(texts), 7) for m in vocab.encode_many(texts[at : at + 7], 0.1, 3, 4, keys[at : at + 7], kept)] == alone


def test_each_occurrence_draws_for_itself():
    """As often varied as candidates are skipped, for every frequent run; with a bound of 4, some never are."""
    vocab = pieces.vocabulary(PIECES)
    n = 4_000
    for run in (" de", " to", " that", " international"):
        plain, merges = vocab.plain([run])[run]
        text = (run * n)[1:]
        made = vocab.encode(text, 0.1, 17, doc_key=5)
        assert vocab.decode(made) == text and made != vocab.encode(text, 0.1, 17, doc_key=6)
        bits = pieces.place_bits(n, 17, 5).tolist()
        alone = [vocab.encode_run(run, pieces.Skips(pieces.gap_table(0.1), b)) for b in bits]
        assert b"".join(alone) == made
        varied = np.mean([a != plain for a in alone])
        drawn = np.mean([pieces.gap_table(0.1)[b & 4095] < merges for b in bits])
        assert abs(drawn - (1 - 0.9**merges)) < 0.03 and 0.5 * drawn < varied <= drawn


def test_what_is_kept_changes_no_draws(documents, monkeypatch):
    vocab = pieces.vocabulary(PIECES)
    texts = [d["text"] or "" for d in documents]
    keys = list(range(len(texts)))
    gaps = pieces.gap_table(0.3)
    alone = []
    for text, key in zip(texts, keys):
        runs = vocab.split(text)
        drawn = pieces.place_bits(len(runs), 3, key).tolist()
        alone.append(b"".join(vocab.encode_run(run, pieces.Skips(gaps, b)) for run, b in zip(runs, drawn)))
    assert all(vocab.decode(made) == text for made, text in zip(alone, texts))
    for limit in (1, 5, 300, 200_000):
        monkeypatch.setattr(pieces.Kept, "limit", limit)
        monkeypatch.setattr(pieces.Kept, "core", limit // 2)
        cores = [{}, {}]
        for _ in range(2):
            kept = pieces.Kept(2, cores)
            assert [m for at in range(0, len(texts), 7) for m in vocab.encode_many(texts[at : at + 7], 0.3, 3, 0, keys[at : at + 7], kept)] == alone


def test_runs_merged_together_are_those_merged_alone(monkeypatch):
    """Of all lengths, with characters without a piece, many skips, and parts that end within a text; nothing is kept between calls."""
    vocab, rnd = pieces.vocabulary(PIECES), random.Random(4)
    texts = ["", " ", "   ", "\0", "\u2581a \u2581", "\U000fe000\U0010ffff x", "\ud800 y", " lead", "trail ", "a  b", "international " * 50, "x" * 300]
    texts += [" ".join("".join(rnd.choice("thereationsingé漢") for _ in range(rnd.randint(1, 60))) for _ in range(rnd.randint(1, 80))) for _ in range(40)]
    keys = [rnd.randint(-(1 << 63), (1 << 63) - 1) for _ in texts]
    for skip, part in ((0.0, 1 << 17), (0.1, 1 << 17), (0.6, 7), (1.0, 1 << 17)):
        monkeypatch.setattr(pieces, "PART", part)
        gaps, alone = pieces.gap_table(skip), []
        for text, key in zip(texts, keys):
            runs = vocab.split(text)
            assert "".join(runs) == (" " + text if text else "")
            drawn = pieces.place_bits(len(runs), 3, key).tolist()
            alone.append(b"".join(vocab.encode_run(run, pieces.Skips(gaps, b)) for run, b in zip(runs, drawn)))
        kept = pieces.Kept(2)
        assert vocab.encode_many(texts, skip, 3, 0, keys, kept) == alone
        assert not any(kept.late) and not any(kept.before)
        assert vocab.decode_each(*vocab.encode_each(texts, skip, 3, keys)) == [t.encode("utf-8", "surrogatepass") for t in texts]


def test_encoded_documents(awkward, documents, empty):
    encoded = pieces.encode_documents(awkward, PIECES)
    assert encoded.where("NOT lossless").count() == 0
    texts = Counter((r.doc_id, r.text) for r in pieces.decode_documents(encoded, PIECES).collect())
    assert texts == Counter((d["doc_id"], d["text"] or "") for d in documents)
    again = pieces.encode_documents(awkward.repartition(2, "lang"), PIECES)
    rows = lambda df: Counter((r.doc_id, tuple(r.pieces), r.n_pieces, r.text_chars) for r in df.collect())
    assert rows(encoded) == rows(again)
    assert pieces.encode_documents(empty, PIECES).count() == 0
