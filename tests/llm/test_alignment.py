"""Token alignment against sets of byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chronosift.llm import alignment

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def brute_tokens(coders, text):
    """Ids and bytes of both sides by the libraries themselves."""
    if not text:
        return [], []
    letters = alignment.byte_letters()
    a = [(i, bytes(letters[c] for c in coders[0].id_to_token(i))) for i in coders[0].encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in coders[1].encode(text, num_threads=1):
        piece = coders[1].id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if coders[1].is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if any(b"".join(p for _, p in side) != whole for side in (a, b)):
        return [], []
    return a, b


def spans(side):
    out, at = [], 0
    for i, piece in side:
        out.append((i, at, at + len(piece)))
        at += len(piece)
    return out


def brute(coders, docs):
    rows, counts = [], Counter()
    for doc, text in docs:
        a, b = (spans(s) for s in brute_tokens(coders, text))
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, before = [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for i, s, e in a if before <= s and e <= cut) + "|"
                          + ",".join(str(i) for i, s, e in b if before <= s and e <= cut))
            before = cut
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        counts.update(links)
        rows.append((doc, len(a), len(b), groups, links))
    top = defaultdict(int)
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return sorted([(doc, n_a, n_b, len(groups), len(links), sum(counts[p] == top[p[1]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
                   for doc, n_a, n_b, groups, links in rows], key=repr)


def sample():
    rng = random.Random(12)
    pieces = ["the", "alignment", "tokenizers", "isn't", "日本語", "😀", "naïve", "1234567", "don't", "  ", "\n\n", "\t", "x" * 40,
              "http://a.b/c?d=e", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "ﬁ", " ", "\x01", "Ünïcödé", "…", "\r\n"]
    docs = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    docs += [(100 + i, "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2000), rng.randrange(0x1f300, 0x1f700)]))
                               for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    docs += [(200, None), (201, ""), (202, " "), (203, "a ▁ b"), (204, "a"), (204, "a"), (None, "no id"), (205, "same words " * 60)]
    return docs


@pytest.mark.parametrize("part", [1_000_000, 50])
def test_report(spark, coders, monkeypatch, part):
    docs = sample()
    monkeypatch.setattr(alignment, "BLOCK", 500)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("number", F.lit(1)).withColumn("pair", F.lit(2)).withColumn("id", F.lit(3))
    found = alignment.Alignment(df)
    zero = F.lit(0)
    got = found.documents.join(found.sums(part), "number", "left").select(
        "id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero), F.coalesce("count_sum", zero), "groups_sha256")
    want = brute(coders, docs)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert sum(w[1] == 0 for w in want) >= 3
    if part == 1_000_000:
        assert sorted((tuple(r) for r in alignment.report(df).collect()), key=repr) == want


def test_long_text(spark, coders):
    """Links of a text of a million characters are as many as tokens less shared ends."""
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "beta", "gamma-ray", "délta", "12"]) for _ in range(150_000)) + " " * 300_000 + "z" * 300_000
    r = alignment.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    a, b = brute_tokens(coders, text)
    ends = [{e for _, _, e in spans(s)} for s in (a, b)]
    assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (len(a), len(b), len(ends[0] & ends[1]), len(ends[0] | ends[1]))


def test_empty(spark):
    assert alignment.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs():
    """A stretch ends at its first difference, wherever it is, and never past an end."""
    for size in (1, 2, 3, 7, 8, 33, 100):
        first = list(range(1, size + 1))
        assert alignment.equal_run(first, first, 0, 0) == size
        assert alignment.equal_run(first, [0, *first], 0, 1) == size
        for at in range(size):
            other = [x + (i >= at) * 1000 for i, x in enumerate(first)]
            assert alignment.equal_run(first, other, 0, 0) == at
    stretches, left, right = alignment.align([1, 2, 5, 6, 9], [1, 2, 3, 4, 5, 6, 7, 9])
    assert stretches == [(0, 2, 0, 2), (2, 3, 2, 5), (3, 4, 5, 6), (4, 5, 6, 8)]
    assert list(zip(left, right)) == [(0, 0), (1, 1), (2, 2), (2, 3), (2, 4), (3, 5), (4, 6), (4, 7)]


def test_vocabulary(coders):
    mine = alignment.ByteLevel(alignment.tokenizer_path(alignment.FIRST))
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(1, 0xd800), rng.randrange(0xe000, 0x110000), 32, 10, 39]))
                       for _ in range(rng.randrange(1, 30)))
        assert mine(text) == coders[0].encode(" " + text, add_special_tokens=False).ids


def test_runs_of_bytes():
    """Probes of bytes find the stretches that probes of numbers find, whatever follows."""
    rng = random.Random(3)
    for size in (1, 2, 15, 16, 17, 31, 32, 47, 48, 49, 100, 300):
        a = [rng.randrange(256) for _ in range(size)]
        for at in range(size + 1):
            b = [0, *a[:at], *((x + 128) % 256 for x in a[at:at + 1]), *a[at + 1:], *[0] * rng.randrange(3)]
            assert alignment.equal_bytes(bytes(a), bytes(b), 0, 1) == alignment.equal_run(a, b, 0, 1) == at
            assert alignment.equal_bytes(bytes(b), bytes(a), 1, 0) == at
    assert alignment.equal_bytes(b"\0\0", b"\0", 0, 0) == 1


@pytest.mark.parametrize("wide", [1, 300])
def test_links(wide):
    """Links and groups against sets of ranges, for lengths that fit in bytes and those that don't."""
    rng = random.Random(wide)
    for _ in range(200):
        ends = sorted(rng.sample(range(1, 80), rng.randrange(1, 60)))
        first, second = ([wide * e for e in ends if e == ends[-1] or rng.random() < 0.8] for _ in range(2))
        stretches, left, right = alignment.align(first, second)
        starts = [[0, *side[:-1]] for side in (first, second)]
        assert list(zip(left.tolist(), right.tolist())) == [
            (i, j) for i in range(len(first)) for j in range(len(second))
            if starts[0][i] < second[j] and starts[1][j] < first[i]]
        groups = sum(i_end - i if first[i] == second[j] else 1 for i, i_end, j, j_end in stretches)
        assert groups == len(set(first) & set(second))


def test_group_text():
    """Ids of each group, the first side's before the second's."""
    import numpy as np
    aligner = alignment.Aligner(*(alignment.tokenizer_path(n) for n in (alignment.FIRST, alignment.SECOND)))
    a, b = np.array([7, 50000, 0, 12]), np.array([31999, 5, 6, 1])
    said = aligner.groups(np.array([0, 2, 3]), np.array([0, 2, 3]), a, b)
    assert said == b"7|31999;50000,0|5,6;12|1"
    assert aligner.groups(np.array([3]), np.array([0]), a, b[:1]) == b"7,50000,0,12|31999"
    assert aligner.groups(np.array([0]), np.array([3]), a[:1], b) == b"7|31999,5,6,1"
