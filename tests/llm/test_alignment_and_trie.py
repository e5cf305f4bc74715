"""Token alignment and the trie of conversations, each against a plain version of itself."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siglab.llm import alignment, conversation_trie, queries

A, B, RANKS = map(queries.tokenizer_path, ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
TEXTS = [
    "Plain words, and then some more of them.", "", None, "a", " two  spaces   and \t tabs\n\nlines ", "<|endoftext|> <s> </s> <unk>", "naïve café coöperation ñandú", "中文字符 と かな 한국어", "emoji 🙂🙂 and 👩‍👩‍👧", "▁ underscores ▁",
    "x" * 3000, "it's they're we'll I'd", "1234567 89,000.50", "\x00\x01 control", "é combining", " " * 2500 + "end", "Ω≈ç√∫", "Plain words, and then some more of them.", " no-break space", "supercalifragilistic antidisestablishmentarianism",
]


def plain_alignment(texts):
    """Rows of (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) by loops over tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    entries = {i: t for t, i in first.get_vocab().items()}
    char = alignment._unprintable()
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    out, counts = [], Counter()
    for text in texts:
        links, groups, n = [], [], (0, 0)
        if text:
            ids = first.encode(f" {text}", add_special_tokens=False).ids, second.encode(text)
            told = [[bytes(char[c] for c in entries[i]) for i in ids[0]], [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(second.id_to_piece, ids[1])]]
            if all(b"".join(x) == f" {text}".encode() for x in told):
                ends = []
                for x in told:
                    at, e = 0, []
                    for t in x:
                        at += len(t)
                        e.append(at)
                    ends.append(e)
                n = len(ids[0]), len(ids[1])
                at_end = dict(zip(ends[1], ids[1]))
                links = [(a, at_end[e]) for a, e in zip(ids[0], ends[0]) if e in at_end]
                cuts = sorted(set(ends[0]) & set(ends[1]))
                for low, high in zip([0, *cuts], cuts):
                    groups.append("|".join(",".join(str(i) for i, e in zip(*x) if low < e <= high) for x in zip(ids, ends)))
        counts.update(links)
        out.append((*n, links, ";".join(groups)))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(a, b, len(x), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), g) for a, b, x, g in out]


@pytest.mark.parametrize("size", [1 << 20, 12])
def test_alignment_equals_loops_over_tokens(spark, docs, size):
    rng = random.Random(5)
    words = [w for t in TEXTS if t for w in t.split()] + ["the", "of", "alignment", "ses"]
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    frame = docs(list(enumerate(texts))).withColumn("n_a", F.lit("x")).withColumn("a", F.lit(1))
    got = alignment.aligned(frame, A, B, RANKS, with_groups=True, piece=size, slice_=300 if size < 100 else 1 << 20).toPandas().set_index("doc_id")
    for i, want in enumerate(plain_alignment(texts)):
        row = got.loc[i]
        assert (row.n_a, row.n_b, row.n_groups, row.n_links, row.n_best, row.count_sum, row.groups) == want, texts[i]
        assert row.groups_sha256 == (hashlib.sha256(want[-1].encode()).hexdigest() if want[-1] else "")


def test_both_ways_to_the_first_ids_agree():
    quick, slow = alignment._A(A, RANKS), alignment._A(A, None)
    samples = [f"{x}{chr(c)}{y}" for c in range(0x250) for x in ("", "a", " ", "1") for y in ("", "b", " ", "\n")]
    for text in [*samples, " ".join(samples), *(t for t in TEXTS if t)]:
        assert quick.encode(text) == slow.encode(text), repr(text[:50])
    assert quick.encode(" " * 200_000) == slow.encode(" " * 200_000)


def test_linked_pairs_are_bounded_by_the_vocabularies(spark, docs):
    a, b = alignment._a(A, RANKS), alignment._b(B)
    for text in filter(None, TEXTS):
        for own, other in alignment._encoded([text], a, b) or []:
            x, y = a.lengths[own].cumsum().tolist(), b.lengths[other].cumsum().tolist()
            for e in set(x) & set(y):
                one, two = a.bytes[own[x.index(e)]], b.bytes[other[y.index(e)]]
                assert one.endswith(two) or two.endswith(one)


def test_alignment_of_awkward_tables(spark, awkward):
    got = alignment.aligned(awkward, A, B, RANKS)
    rows = got.toPandas()
    assert len(rows) == awkward.count() and list(got.columns) == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    none = rows[rows.n_a == 0]
    assert len(none) == 4 and (none[["n_b", "n_groups", "n_links", "n_best", "count_sum"]] == 0).all(axis=None) and (none.groups_sha256 == "").all()
    long = rows[rows.doc_id == 4].iloc[0]
    assert long.n_groups > 100_000
    assert alignment.aligned(awkward.limit(0), A, B, RANKS).count() == 0


# Trie


def plain_trie(rows):
    """Nodes of the conversations in ``rows`` (conv_id, turn, role, text), by dictionaries of prefixes."""
    talks = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        talks[c].append((role or "", text or ""))
    grown = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        grown[c] = talks.get(c - c % 20, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in sorted(grown.items()):
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    kids, saved, leaves = Counter(), Counter(), Counter()
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        cost = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += cost
            leaves[p[:d]] += not kids[p]
    out = []
    for p, m in members.items():
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def talks(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def found(frame):
    return sorted(map(tuple, conversation_trie.of_conversations(frame).collect()), key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_dictionaries_of_prefixes(spark, monkeypatch, seed):
    monkeypatch.setattr(conversation_trie, "TURNS_A_CHUNK", 3)
    monkeypatch.setattr(conversation_trie, "IDS_A_CHUNK", 4)
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 75, 1), 1_000_000_007, 1_000_000_020]:
        turns = [(c, rng.choice([k, k, k, None if k < 2 else k]), rng.choice(["user", None]) if k % 2 else "user", rng.choice(["", None, "hi", "hi", "one two\tthree", "a  b"])) for k in range(rng.choice([1, 2, 3, 5, 9]))]
        rows += turns + turns[:1] * rng.randrange(2)
    rows += [(None, 1, "user", "lost"), (None, None, None, None)]
    assert found(talks(spark, rows)) == plain_trie(rows)


def test_a_deep_comb_takes_few_rounds(spark, monkeypatch):
    """A conversation of 60 turns, of which a branch goes off at each: a level-by-level walk would take 60 rounds."""
    rows = [(20 * k, t, "user", f"t{t}") for k in range(60) for t in range(k + 1)] + [(20 * k + 2000, t, "user", f"t{t}" if t < k else "off") for k in range(60) for t in range(k + 1)]
    rounds = []
    step = conversation_trie._round
    monkeypatch.setattr(conversation_trie, "_round", lambda s: rounds.append(1) or step(s))
    assert found(talks(spark, rows)) == plain_trie(rows)
    assert len(rounds) < 20


def test_trie_of_equal_conversations_and_of_none(spark):
    rows = [(c, t, "user", "same words here") for c in range(0, 40_000, 20) for t in range(2)] + [(7, 0, "user", "x")]
    assert found(talks(spark, rows)) == plain_trie(rows)
    assert found(talks(spark, rows[:0])) == []
    extra = talks(spark, rows[:4]).withColumn("depth", F.lit("x")).withColumn("a", F.lit(None).cast("int"))
    assert found(extra) == plain_trie(rows[:4])
