"""License scans, BPE, token counts and media against brute force on small tables."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest

from matchlight.llm import bpe_tree, license_scan, mpeg_audio, token_trie

P = pytest.importorskip("public_tokenizers")

TEXTS = [
    None,
    "",
    " ",
    "Released under the MIT License. Under the mit license under the MIT\nlicense",
    "Licensed under CC BY-NC 4.0. cc by nc cc by nc",
    "x" * 5000 + " Apache License, Version 2.0",
    "naïve ÉTÉ über—straße 東京   tab\tnew\n\nline  " * 120,
    "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause\nrest",
    "don't can't we'll I'm it's 'tis '''s  12345 678\r\n\x0b\x1c\x1d " * 60,
    "same text",
    "same text",
]


def table(spark, texts=TEXTS):
    rows = [(i, t, "en", "s", 7, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, labels string").repartition(3)


def rows_by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def brute_places(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    at, labels = [], set()
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_scan_matches_brute_force(spark):
    got = rows_by_id(license_scan.scan(table(spark)))
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_places(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert got[7]["labels"] == "bsd-3-clause,gpl-2-only,mit" and got[7]["score"] == pytest.approx(0.9)


@pytest.mark.parametrize(
    "text, postfix",
    [
        ("MIT", ["mit"]),
        ("MIT OR Apache-2.0 AND BSD", ["mit", "apache-2.0", "bsd", "and", "or"]),
        ("(MIT OR Apache-2.0) AND BSD", ["mit", "apache-2.0", "or", "bsd", "and"]),
        ("GPL-2.0 WITH Classpath-exception-2.0 OR MIT", ["gpl-2.0", "classpath-exception-2.0", "with", "mit", "or"]),
        ("(MIT", None),
        ("MIT)", None),
        ("MIT OR", None),
        ("AND MIT", None),
        ("MIT BSD", None),
        ("", None),
    ],
)
def test_shunting_yard(text, postfix):
    assert license_scan.to_postfix(text) == postfix


@pytest.mark.parametrize(
    "text, labels, n",
    [
        ("/* SPDX-License-Identifier: MIT */", "mit", 1),
        ("<!-- SPDX-License-Identifier: Apache-2.0 OR MIT -->\nrest", "apache-2,mit", 1),
        ("<!--SPDX-License-Identifier: GPL-2.0+-->", "gpl-2+", 1),
        ("/* SPDX-License-Identifier: GPL-2.0-only */", "gpl-2-only", 1),
        ('License-Expression: "MIT"', "mit", 1),
        ('{"license-expression": "Apache-2.0 OR MIT", "x": 1}', "apache-2,mit", 1),
        ("é SPDX License Identifier: ISC OR MIT, see LICENSE", "isc,mit", 1),
        ("SPDX-License-Identifier: GPL-3.0-or-later. Some prose", "gpl-3-or-later", 1),
        ("the license expression is MIT", "", 0),
        ("License-Expression: MIT is what we use", "mit", 1),
        ("See License-Expression: (MIT OR ISC) AND BSD-3-Clause. Or ask", "bsd-3-clause,isc,mit", 1),
        ("License-Expression: MIT AND (see below", "mit", 1),
        ("SPDX-License-Identifier: MIT) SPDX-License-Identifier: ISC", "isc,mit", 2),
        ("SPDX-License-Identifier: MIT OR SPDX-License-Identifier:\nISC", "mit", 1),
        ("SPDX-License-Identifier: */ MIT", "", 0),
        ("SPDX-License-Identifier: (MIT", "", 0),
    ],
)
def test_expression_ends_where_it_cannot_go_on(text, labels, n):
    got = license_scan.kernel(license_scan.automaton())(text)
    assert (got[5], got[7]) == (labels, n)


def test_expression_values():
    labels, score = license_scan.evaluate(license_scan.to_postfix("GPL-2.0 WITH Classpath AND MIT"))
    assert labels == {"gpl-2-with-classpath", "mit"} and score == 0.6


def test_many_places_in_one_text():
    scan = license_scan.kernel(license_scan.automaton())
    n = 300_000
    got = scan("under the MIT license " * n)
    assert got[:6] == (4 * n, n, 0, 4 * n - 4, "mit", "mit") and len("under the MIT license " * n) > 5_000_000


def reference_encoder():
    return bpe_tree.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 64])
def test_tree_encoding_equals_one_pass(leaf):
    encode, table_ = reference_encoder()
    rng = random.Random(leaf)
    alphabet = "ab'sltredm 1\n\t é東.,!  \x1c"
    for n in (0, 1, 2, 5, 17, 90, 400):
        for _ in range(25):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            ids = bpe_tree.encode(text, encode, table_, leaf)
            assert ids == encode(text)
            assert bpe_tree.decode(ids, table_, leaf) == text.encode()
    long = "abcdefgh" * 3000
    assert bpe_tree.encode(long, encode, table_, 100) == encode(long)


def test_bpe_query(spark):
    encode, table_ = reference_encoder()
    got = rows_by_id(bpe_tree.digests(table(spark), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN))
    for i, text in enumerate(TEXTS):
        ids = encode(text or "")
        want = len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want
    full = rows_by_id(bpe_tree.encoded(table(spark), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN))
    assert all(full[i]["ids"] == encode(t or "") for i, t in enumerate(TEXTS))


@pytest.mark.parametrize("unit", [" ", "\n", " \t", "\u3000"])
@pytest.mark.parametrize("before, after", [("", ""), ("a", "b"), ("a.", ""), ("", "'s 1")])
def test_long_white_space(unit, before, after):
    encode, table_ = reference_encoder()
    library = encode.__closure__
    ordinary = next(c.cell_contents for c in library if hasattr(c.cell_contents, "encode_ordinary")).encode_ordinary
    text = before + unit * 30_000 + after
    assert bpe_tree.encode(text, encode, table_) == ordinary(text)


@pytest.mark.parametrize("text", [" " * 10_000_000, "a" + " " * 2_000_000 + "b" + "\n" * 2_000_000, "東京都市" * 250_000, "abcdefgh" * 125_000 + "!" * 100_000])
def test_very_long_texts_are_encoded(text):
    encode, table_ = reference_encoder()
    ids = bpe_tree.encode(text, encode, table_)
    assert bpe_tree.decode(ids, table_) == text.encode()


def test_unspaced_text_has_stable_places():
    encode, table_ = reference_encoder()
    rng = random.Random(5)
    text = "".join(rng.choice("東京都市を見た。、「」12'ab") for _ in range(20_000))
    assert sum(bpe_tree.stable(text, i) for i in range(1, len(text))) > 5_000
    assert bpe_tree.encode(text, encode, table_, 64) == encode(text)


def brute_pieces(word, scores):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(best[end - 1][0] + n * token_trie.BYTE_SCORE, -(n - best[end - 1][1]))]
        options += [(best[a][0] + scores[word[a:end]], best[a][1] - 1) for a in range(end) if word[a:end] in scores]
        best.append(max(options))
    return -best[-1][1]


def test_token_counts(spark):
    path = P.path("piece_bpe_32k.model")
    scores = token_trie.vocabulary(path)
    got = rows_by_id(token_trie.token_counts(table(spark), path))
    for i, text in enumerate(TEXTS):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert got[i]["n_pretokens"] == len(words)
        if i != 5:
            assert got[i]["n_tokens"] == sum(brute_pieces(token_trie.MARK + w, scores) for w in words)


def test_a_word_of_any_length_is_counted_without_nodes():
    scores = token_trie.vocabulary(P.path("piece_bpe_32k.model"))
    trie = token_trie.Trie(scores, mark=token_trie.MARK)
    rng = random.Random(1)
    word = "".join(rng.choice("abcdeé東") for _ in range(6000))
    n = trie.count(word)
    assert len(trie.best) == 1 and n == brute_pieces(token_trie.MARK + word, scores)
    assert trie.count("ab" * 5_000_000) > 0 and len(trie.best) == 1 and not trie.counts


def test_trie_shares_prefixes_and_survives_resets():
    scores = {"a": -1.0, "ab": -1.5, "b": -2.0, "abc": -4.0, "c": -1.0}
    trie, small = token_trie.Trie(scores), token_trie.Trie(scores, max_nodes=3)
    for w in ("abc", "abcabc", "cab", "", "zz", "ab"):
        assert trie.count(w) == small.count(w) == (brute_pieces(w, scores) if w else 0)
    assert len(trie.best) == 1 + len("abcabc") + len("cab") + len("zz")


def test_media_query(spark):
    files = mpeg_audio.media(table(spark))
    got = rows_by_id(mpeg_audio.features(files))
    stored = rows_by_id(files)
    for i, text in enumerate(TEXTS):
        data = (text or "").encode()
        payload = mpeg_audio.pad(data)
        r = got[i]
        assert r["n_bytes"] == len(data) and r["payload_bytes"] == len(payload) and len(payload) % 64 == 0 and payload
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(stored[i]["media"]).hexdigest() and r["media_bytes"] == len(stored[i]["media"])
        assert r["bad_frames"] == r["skipped_bytes"] == 0 and r["table_frames"] == r["n_frames"]
        assert r["n_samples"] == 1152 * r["n_frames"]
        media = bytes(stored[i]["media"])
        assert all(mpeg_audio.parse_header(media[o : o + 4]) for o in r["seek_offsets"]) and len(r["seek_offsets"]) == r["n_frames"]


@pytest.mark.parametrize("n", [0, 1, 64, 184, 185, 1021, 1022, 50_000])
def test_audio_keeps_any_bytes(n):
    data = random.Random(n).randbytes(n) if n % 2 else b"\xff\xfa" * (n // 2)
    assert mpeg_audio.decode(mpeg_audio.encode(data))["payload"] == data


def test_audio_resynchronises_and_checks():
    data = bytes(range(128)) * 60
    media = mpeg_audio.encode(data)
    x = mpeg_audio.decode(media)
    o = x["offsets"]
    junk = media[: o[2]] + b"\xff\xfajunk\xff" + media[o[2] :]
    y = mpeg_audio.decode(junk)
    assert y["payload"] == data and y["skipped"] == 7
    broken = bytearray(media)
    broken[o[1] + 8] ^= 1
    z = mpeg_audio.decode(bytes(broken))
    assert z["bad"] == 1 and z["frames"] == x["frames"] - 1
    assert mpeg_audio.decode(b"")["frames"] == 0 and mpeg_audio.decode(b"\xff" * 50)["frames"] == 0
    assert x["seek_error"] == 0
    total = struct.unpack(">I", media[media.index(b"Xing") + 12 :][:4])[0]
    assert total == len(media) - 128 - mpeg_audio.read_tag(media)[0]


def frames(version, layer, index, rate, n, side=b"", crc=False):
    """n frames made by hand from the header's bits; version 1, 2 or 2.5."""
    bits = {1: 3, 2: 2, 2.5: 0}[version] << 3 | (4 - layer) << 1 | (not crc)
    header = bytes([0xFF, 0xE0 | bits, index << 4 | rate << 2, 0xC0])
    size = mpeg_audio.parse_header(header).size
    return [header + side + bytes([i % 200 + 1]) * (size - 4 - len(side)) for i in range(n)]


@pytest.mark.parametrize(
    "version, layer, index, rate, size, samples, hz",
    [(1, 1, 12, 0, 416, 384, 44100), (1, 2, 10, 1, 576, 1152, 48000), (1, 3, 9, 0, 417, 1152, 44100), (2, 3, 8, 0, 208, 576, 22050), (2, 2, 8, 1, 384, 1152, 24000), (2.5, 3, 8, 0, 417, 576, 11025), (2.5, 1, 4, 2, 384, 384, 8000)],
)
def test_versions_and_layers(version, layer, index, rate, size, samples, hz):
    made = frames(version, layer, index, rate, 9)
    assert len(made[0]) == size
    x = mpeg_audio.decode(b"junk\xff\xfb" + b"".join(made) + made[0][:50])
    assert (x["frames"], x["samples"], x["rate"], x["skipped"], x["bad"]) == (9, 9 * samples, hz, 56, 0)
    assert x["offsets"] == [6 + i * size for i in range(9)]


@pytest.mark.parametrize("flags, told", [(0, (-1, -1, b"")), (1, (77, -1, b"")), (2, (-1, 88, b"")), (3, (77, 88, b"")), (5, (77, -1, bytes(range(100)))), (15, (77, 88, bytes(range(100))))])
def test_table_fields_by_their_flags(flags, told):
    made = frames(1, 3, 9, 0, 4)
    body = b"Xing" + struct.pack(">I", flags) + (struct.pack(">I", 77) if flags & 1 else b"") + (struct.pack(">I", 88) if flags & 2 else b"") + (bytes(range(100)) if flags & 4 else b"")
    first = made[0][:4] + bytes(17) + body
    x = mpeg_audio.decode(first + bytes(417 - len(first)) + b"".join(made))
    assert x["table"] == told and x["frames"] == 4


def test_other_table_form():
    made = frames(1, 3, 9, 0, 10)
    first = made[0][:4] + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 11 * 417, 10, 5, 1, 2, 2) + b"".join(struct.pack(">H", 834) for _ in range(5))
    x = mpeg_audio.decode(first + bytes(417 - len(first)) + b"".join(made))
    assert x["table"][:2] == (10, 4587) and len(x["table"][2]) == 100 and x["frames"] == 10
    assert 0 <= x["seek_error"] < 60


def tag(version, frames_, flags=0, extra=b""):
    body = extra + frames_
    return b"ID3" + bytes([version, 0, flags]) + mpeg_audio.syncsafe(len(body)) + body


def test_tags_of_all_versions():
    text = b"\x03payload\x0042"
    long = b"\x00payload\x00" + b"1" * 200
    for made, want in (
        (tag(4, b"TXXX" + mpeg_audio.syncsafe(len(text)) + b"\0\0" + text), "42"),
        (tag(4, b"TXXX" + mpeg_audio.syncsafe(len(long)) + b"\0\0" + long), "1" * 200),
        (tag(4, b"TXXX" + mpeg_audio.syncsafe(len(text)) + b"\0\0" + text, 0x40, mpeg_audio.syncsafe(6) + b"\x01\x00"), "42"),
        (tag(3, b"TXXX" + struct.pack(">I", len(long)) + b"\0\0" + long), "1" * 200),
        (tag(3, b"TXXX" + struct.pack(">I", len(text)) + b"\0\0" + text, 0x40, struct.pack(">I", 6) + bytes(6)), "42"),
        (tag(2, b"TXX" + len(text).to_bytes(3, "big") + text), "42"),
        (tag(3, b"TXXX" + struct.pack(">I", 31) + b"\0\0" + b"\x01" + "payload\0".encode("utf-16") + "no".encode("utf-16") + b"\0" * 6), "no"),
    ):
        end, fields = mpeg_audio.read_tag(made + b"rest")
        assert end == len(made) and fields["payload"].rstrip("\0") == want, made
    data = tag(3, b"TXXX" + struct.pack(">I", 14) + b"\0\0" + b"\x00payload\x00many") + b"".join(frames(1, 3, 9, 0, 3))
    assert len(mpeg_audio.decode(data)["payload"]) == 3 * (417 - 4 - 17)
    assert mpeg_audio.read_tag(b"ID3\x03") == (0, {}) and mpeg_audio.read_tag(b"ID3\x09" + bytes(20)) == (0, {})


@pytest.mark.parametrize("seed", range(4))
def test_any_bytes_are_read(seed):
    rng = random.Random(seed)
    media = bytearray(mpeg_audio.encode(rng.randbytes(9000)))
    for _ in range(200):
        media[rng.randrange(len(media))] = rng.choice((0xFF, 0xFB, 0, rng.randrange(256)))
    x = mpeg_audio.decode(bytes(media))
    assert x["frames"] == len(x["offsets"]) and x["skipped"] >= 0
    mpeg_audio.decode(rng.randbytes(5000))
    mpeg_audio.decode(b"ID3" + rng.randbytes(300))


def test_empty_table(spark):
    empty = table(spark).limit(0)
    assert license_scan.scan(empty).count() == 0
    assert token_trie.token_counts(empty, P.path("piece_bpe_32k.model")).count() == 0
    assert mpeg_audio.features(mpeg_audio.media(empty)).count() == 0
    assert bpe_tree.digests(empty, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
