"""Archives with damage, letters and windows of the language model, long spelled-out addresses."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import zstandard

from regionhour.llm import language, personal_data, registry, warc
from tests.compare import connect, differences

SMALL = "/root/testdata/sf0.001"


def test_archive_query_agrees_with_sql(spark):
    for sf in (SMALL, "/root/testdata/sf0.01"):
        assert differences(registry.queries()["op4_warc"](spark, sf), connect(sf), registry.oracle_sql()["op4_warc"]) is None


def record(n: int) -> bytes:
    body = f"body {n} ".encode() * 20
    return warc.record_bytes(n, "u", body, hashlib.sha256(body).hexdigest(), len(body), None)


def test_damage_is_a_row_and_reading_goes_on(spark, folder):
    packer = zstandard.ZstdCompressor()
    frames = [packer.compress(record(n)) for n in range(6)]
    frames[1] = packer.compress(record(1).replace(b"body 1 ", b"body x "))  # digest differs
    frames[3] = frames[3][:8] + bytes([frames[3][8] ^ 255]) + frames[3][9:]  # broken inside
    archive = b"".join(frames) + b"P*M\x18\x00\x00\x00\x00" + frames[0][:-5]  # cut off
    (spark.createDataFrame([(bytearray(archive),)], "content binary").mapInPandas(warc._records, warc.RECORD)).createOrReplaceTempView("damaged")
    rows = spark.table("damaged").collect()
    assert [r["page_id"] for r in rows if r["error"] is None] == [0, 2, 4, 5]
    wrong = [r["error"] for r in rows if r["error"]]
    assert any("digest" in e for e in wrong) and any("ends inside" in e for e in wrong) and 3 <= len(wrong) <= 6
    assert all(r["page_id"] is None and r["payload"] is None for r in rows if r["error"])


def test_frames_are_found_in_linear_time():
    packer = zstandard.ZstdCompressor(write_checksum=True)
    pieces = [b"", b"a" * 300_000, random.Random(1).randbytes(300_000), *[record(n) for n in range(40)]]
    archive = b"".join(packer.compress(p) for p in pieces)
    assert list(warc.frames_of(archive)) == pieces
    streamed = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    assert list(warc.frames_of(streamed.compress(b"xyz" * 1000) + streamed.flush())) == [b"xyz" * 1000]

    def took(n: int) -> float:
        whole = b"".join(packer.compress(random.Random(k).randbytes(2000)) for k in range(n))
        began = time.perf_counter()
        assert sum(1 for _ in warc.frames_of(whole)) == n
        return time.perf_counter() - began

    took(200)
    assert took(8000) < 40 * max(took(1000), 0.005)


def test_digits_and_fractions_are_no_letters(spark):
    rows = [(1, "²½① 12 _"), (2, "x²"), (3, "½"), (4, "中")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, {"en": "some words x"}).collect()}
    assert got == {1: "und", 2: "en", 3: "und", 4: "en"}


def test_windows_add_at_most_a_phrase_each():
    pick = random.Random(3)
    training = {"a": "".join(pick.choices("abcd ", k=4000)), "b": "".join(pick.choices("abce ", weights=[5, 1, 1, 1, 2], k=4000))}
    parser = language.Parser(training)
    for size in (1, 511, 512, 513, 1024, 5000, 9999):
        text = "".join(pick.choices("abcde ", k=size))
        for k, name in enumerate(parser.languages):
            at = exact = 0
            while at < size:
                step = 1
                while at + step <= size and text[at:at + step] in training[name]:
                    step += 1
                at += max(1, step - 1)
                exact += 1
            assert 0 <= parser.phrases([text])[0][k] - exact <= (size - 1) // language.WINDOW


def test_long_rows_are_learned_from_at_any_length(spark):
    rows = [(i, (f"ab{i} " * 3000 if i % 2 else f"cd {i}"), "xx") for i in range(400)]
    got = language.training_texts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    texts = got["xx"].split("\n")
    assert len(texts) == language.ROWS_PER_LANGUAGE and max(map(len, texts)) == language.LONGEST_TRAINING_ROW
    assert any(t.startswith("cd") for t in texts) and len({t[:2] for t in texts if len(t) == language.LONGEST_TRAINING_ROW}) > 1


def test_a_spelled_out_address_is_taken_whole():
    name = "n" * 200
    text = f"write {name} [at] example [dot] org now"
    [(kind, start, stop)] = [s for s in personal_data.loose_spans(text, []) if s[0] == personal_data.EMAIL]
    assert text[start:stop] == f"{name} [at] example [dot] org"
    began = time.perf_counter()
    personal_data.loose_spans(("x" * 5000 + " [at] ") * 400, [])
    assert time.perf_counter() - began < 5


def test_sixty_languages_in_few_columns(monkeypatch):
    """Columns left out for memory change no count; held-out texts of 60 languages of one alphabet are told apart."""
    rng = np.random.default_rng(60)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzäöüß"))
    words = {f"l{k:02d}": ["".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(150)] for k in range(60)}

    def text(name, n):
        return " ".join(rng.choice(words[name], n))

    training, tests = {name: text(name, 250) for name in words}, {name: text(name, 15) for name in words}
    wide = language.Parser(training)
    monkeypatch.setattr(language, "MOST_CELLS", 8 * sum(2 * len(t) + 1 for t in training.values()))
    narrow = language.Parser(training)
    assert wide.width == 32 and narrow.width == 8 and narrow.cells.size < language.MOST_CELLS
    assert (wide.phrases(list(tests.values())) == narrow.phrases(list(tests.values()))).all()
    assert narrow.predict(list(tests.values()))[0] == list(tests)
    monkeypatch.setattr(language, "MOST_CELLS", 1)
    bare = language.Parser({"a": "aba", "b": ""})
    assert bare.width == 1 and bare.phrases(["abab", ""]).tolist() == [[2, 4], [0, 0]]
