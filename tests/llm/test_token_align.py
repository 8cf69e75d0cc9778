import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from strataloom.llm import token_align as T
from strataloom.llm.queries import op13_token_align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    a, b, back = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), T.byte_of_symbol()
    a.encode_special_tokens = True
    count, docs = Counter(), []
    for doc_id, text in rows:
        sides, want = ([], []), (" " + (text or "")).encode()
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids
            sides[0].extend((i, bytes(back[c] for c in a.id_to_token(i))) for i in ids)
            sides[1].extend((i, bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)])
        if not text or any(b"".join(x for _, x in s) != want for s in sides):
            docs.append((doc_id, [], [], [], []))
            continue
        spans = []
        for s in sides:
            at, own = 0, []
            for i, x in s:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
        owner = [[next(k for k, (_, s, e) in enumerate(own) if s <= at < e) for at in range(len(want))] for own in spans] if len(want) < 300 else None
        if owner:
            places = sorted(set(zip(*owner)))
        else:
            places, j = [], 0
            for k, (_, s, e) in enumerate(spans[0]):
                while spans[1][j][2] <= s:
                    j += 1
                m = j
                while m < len(spans[1]) and spans[1][m][1] < e:
                    places.append((k, m))
                    m += 1
        links = [(spans[0][k][0], spans[1][m][0]) for k, m in places]
        groups, last = [], 0
        for end in sorted({x[2] for x in spans[0]} & {x[2] for x in spans[1]}):
            groups.append("|".join(",".join(str(i) for i, s, e in own if last <= s and e <= end) for own in spans))
            last = end
        count.update(links)
        docs.append((doc_id, spans[0], spans[1], links, groups))
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return sorted(
        (
            (d, len(x), len(y), len(g), len(n), sum(count[k] == best[k[1]] for k in n), sum(count[k] for k in n), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for d, x, y, n, g in docs
        ),
        key=str,
    )


ODD = [
    None, "", " ", "  a  b \n c d é x", "x▁y z", "a <|endoftext|> b <s> </s> <0x0A>", "　 x   y  z", "日本語 テスト 😀 😀😀 ok\x00 \x01 k", "don't 'll  's we're  \t\tq", "trailing  ",
    "a ", " a", "\n", "é ü \x7f y", "a    b\u0085 c", "é o ̈x ﬁ", "×÷ a×b éß, d'été. 12a34 a\n\nb\nc 'sé", "abc" * 500, "x\r\n};\r y", ");\r\n\r\n", "can't've 'S",
]


def test_brute_force(spark):
    r = random.Random(1)
    parts = [" ", " ", " ", "  ", "a", "b", "Word", "é", "\n", "\t", "日", "1", "23", "'s", "!", "...", "😀", "̈", "▁", "\x00", "ſ", "×", "\r", ");", " ", "'"]
    rows = list(enumerate(ODD)) + [(None, "no id"), (3, ODD[3])]
    rows += [(100 + i, "".join(r.choice(parts) for _ in range(r.randint(1, 40)))) for i in range(400)]
    df = spark.createDataFrame([(*x, "k", 1) for x in rows], "doc_id long, text string, key string, n int").repartition(3)
    assert sorted(map(tuple, T.align(df, A, B, with_groups=False).collect()), key=str) == brute(rows)


def test_segments_change_nothing(spark):
    """The ids of segments, put together, are the ids of the whole text."""
    pair = T.Pair.of(A, B)
    assert pair.splits and pair.fast
    for text in [x for x in ODD if x] + ["Größe: l'été, naïve! 3.14 (a+b)=c; foo_bar\nNext line."]:
        raw = np.frombuffer((" " + text).encode(), np.uint8)
        start, end, _ = T.segments(raw, np.array([0, len(raw)]), True)
        number = pair.encode(raw, start, end)
        if (pair.facts[2, number] == 0).any():
            continue
        ids = [pair.ids[pair.start[k] : pair.start[k + 1]].tolist() for k in number]
        n = [int(x) for x in pair.facts[0, number]]
        assert [i for x, m in zip(ids, n) for i in x[:m]] == pair.a.encode(" " + text, add_special_tokens=False).ids
        assert [i for x, m in zip(ids, n) for i in x[m:]] == pair.b.encode(text)


def test_groups_and_counts(spark):
    docs = spark.createDataFrame([(1, "hello there"), (2, "hello")], "doc_id long, text string")
    rows = {r.doc_id: r for r in T.align(docs, A, B).collect()}
    for r in rows.values():
        assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 and r.groups.count(";") == r.n_groups - 1
    counts = {(r.key >> 32, r.key & (2**32 - 1)): r.n for r in T.pair_counts(docs, A, B).collect()}
    assert sum(counts.values()) == sum(r.n_links for r in rows.values())


def test_run_sums_over_batches():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"key": pa.array(k, pa.int64()), "n": pa.array([1] * len(k), pa.int64())}) for k in ([1, 1], [], [1, 2], [2], [2, 3])]
    got = [x for b in T.run_sums(iter(batches)) for x in zip(*b.to_pydict().values())]
    assert got == [(1, 3), (2, 3), (3, 1)]


def test_empty_table(spark):
    assert T.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op13_token_align(spark, folder).collect()), key=str) == brute(rows)
