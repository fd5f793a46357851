"""Sub-word pieces, longest match first, against plain Python."""

import json
import random
import re

import pytest

from sardonyx.operators import encode as EN


def plain(word, vocab, unknown, continued="", end="", longest=EN.PIECE_CHARS):
    out, at = [], 0
    while at < len(word):
        for n in range(min(longest, len(word) - at), 0, -1):
            piece = (continued if at else "") + word[at:at + n] + (end if at + n == len(word) else "")
            if piece in vocab:
                out.append(vocab[piece])
                at += n
                break
        else:
            return [unknown]
    return out


@pytest.mark.parametrize("continued, end", [("##", ""), ("", "</w>"), ("", "")])
def test_random_words(spark, continued, end):
    rng = random.Random(len(continued) + 2 * len(end))
    alphabet = "abcé中"
    vocab = {}
    for _ in range(120):
        piece = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4)))
        vocab.setdefault(rng.choice(["", continued]) + piece + rng.choice(["", end]), len(vocab) + 10)
    texts = [" ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 9)))
             for _ in range(150)] + [None, "", "a" * 40, "ab " * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    pieces = spark.createDataFrame(list(vocab.items()), "token string, token_id int")
    got = {r["id"]: r for r in EN.encode_pieces(df, pieces, ["id"], max_len=20, continued=continued, end=end,
                                                unknown=1, first=2, last=3, pad=0).collect()}
    for i, t in enumerate(texts):
        ids = [x for w in re.findall(r"\w+", t or "") for x in plain(w, vocab, 1, continued, end)][:18]
        want = [2, *ids, 3]
        assert list(got[i]["input_ids"]) == want + [0] * (20 - len(want)), t
        assert list(got[i]["attention_mask"]) == [1] * len(want) + [0] * (20 - len(want))


def test_vocabulary_file(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"model": {"vocab": {"a": 1, "b</w>": 2, 'q"\\': 3, "é": 4}, "merges": []}}), encoding="utf-8")
    got = {r["token"]: r["token_id"] for r in EN.tokenizer_pieces(spark, str(path)).collect()}
    assert got == {"a": 1, "b</w>": 2, 'q"\\': 3, "é": 4}


def test_whole_table(spark):
    import public_tokenizers

    from sardonyx.functions.text import tokens
    from sardonyx.plans import catalog
    from tests.conftest import SF_SMALL
    with open(public_tokenizers.path(catalog.PIECES), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    rows = catalog.labelled_corpus(spark, SF_SMALL).select("origin", "row_id", tokens("text").alias("w")).collect()
    got = {(r["origin"], r["row_id"]): r["input_ids"] for r in catalog.QUERIES["subword_sequences"](spark, SF_SMALL).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = [x for w in r["w"][:126] for x in plain(w, vocab, catalog.PIECES_LAST, "", catalog.PIECES_END)][:126]
        want = [catalog.PIECES_FIRST, *ids, catalog.PIECES_LAST]
        assert got[r["origin"], r["row_id"]] == ",".join(map(str, want + [catalog.PIECES_LAST] * (128 - len(want))))


def test_lists_are_cut_as_whole_columns():
    """A batch's distinct words are cut once; lists of no words, sliced batches and empty batches hold their place."""
    import pyarrow as pa

    class Counted(dict):
        asked = 0

        def get(self, piece):
            Counted.asked += 1
            return super().get(piece)

    class Box:
        value = Counted({"a": 1, "b": 2, "a</w>": 3, "ab</w>": 4})

    cut = EN.piece_cutter(Box, 3, 9, end="</w>")
    words = pa.array([["ab"], [], ["ba", "x", "aab", "ab"], ["a", ""]] + [["ab"] * 50] * 100, pa.list_(pa.string()))
    assert cut(words).to_pylist() == [[4], [], [2, 3, 9], [3, 9]] + [[4, 4, 4]] * 100
    assert Counted.asked < 20
    assert cut(words.slice(2, 2)).to_pylist() == [[2, 3, 9], [3, 9]]
    assert cut(words.slice(1, 1)).to_pylist() == [[]] and cut(words.slice(0, 0)).to_pylist() == []


@pytest.mark.parametrize("continued, end", [("##", ""), ("", "</w>"), ("", "")])
def test_pieces_of_any_length(spark, continued, end):
    """Pieces beyond ``PIECE_CHARS`` are matched too, at the start, inside and at the end of a word."""
    rng = random.Random(7)
    vocab = {a + c + b: i for i, (a, c, b) in enumerate(
        [(a, c, b) for a in {"", continued} for c in "ab" for b in {"", end}], 10)}
    long = ["".join(rng.choice("ab") for _ in range(n)) for n in range(EN.PIECE_CHARS - 2, 3 * EN.PIECE_CHARS)]
    for piece in long + [p[:EN.PIECE_CHARS] + "b" * 9 for p in long if len(p) > EN.PIECE_CHARS]:   # shared first characters
        vocab.setdefault(rng.choice(["", continued]) + piece + rng.choice(["", end]), len(vocab) + 10)
    words = ["".join(rng.choice(long)[:rng.randint(10, 60)] for _ in range(rng.randint(1, 3))) for _ in range(300)] + long
    df = spark.createDataFrame(list(enumerate(words)), "id bigint, text string")
    pieces = spark.createDataFrame([*vocab.items(), (None, 5)], "token string, token_id int")
    got = EN.encode_pieces(df, pieces, ["id"], max_len=200, continued=continued, end=end, unknown=1, first=2, last=3, pad=0)
    capped = 0
    for r in got.collect():
        want = plain(words[r["id"]], vocab, 1, continued, end, longest=1000)
        assert list(r["input_ids"]) == [2, *want, 3] + [0] * (198 - len(want)), words[r["id"]]
        capped += want != plain(words[r["id"]], vocab, 1, continued, end)
    assert capped > 100


def test_long_pieces_of_the_public_vocabulary(spark):
    import public_tokenizers

    from sardonyx.plans import catalog
    pieces = EN.tokenizer_pieces(spark, public_tokenizers.path(catalog.PIECES))
    words = ["interdisciplinary", "telecommunications", "artificialintelligence", "telecommunicationsx"]
    known = {r["token"]: r["token_id"] for r in pieces.collect()}
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    ids = EN.encode_pieces(df, pieces, [], end=catalog.PIECES_END).first()["input_ids"]
    rest = plain(words[3], known, 0, "", catalog.PIECES_END, longest=1000)
    assert list(ids[1:4]) == [known[w + "</w>"] for w in words[:3]]
    assert list(ids[4:4 + len(rest)]) == rest
