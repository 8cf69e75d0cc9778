import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strataloom.llm import shared as S
from strataloom.llm.packing import Words, decomposed, encoded, pack, spans

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = {
    1: None, 2: "", 3: "Hello, World! it's 2024-05-06 <|endoftext|> <|ENDOFTEXT|> a<b", 4: "Été naïve ÉTÉ é ﬁne  x y Ärger Σς İx 日本語123 ½ ٣٤", 5: "x " * 5000, 6: "A" * 3000,
    7: "tab\tnew\nline\r\x0b\x0c\x1cz", 8: "don't we'll O'Reilly's 'tis", 9: "emoji 😀😀 ok", 10: "   ", 11: "#*$%& || <> ### thing*** %%%12abc34",
}


def test_ids_are_the_tokenizers(spark):
    docs = spark.createDataFrame([(k, v, 9) for k, v in TEXTS.items()], "doc_id long, text string, start int")
    rows = pack(docs, PATH, longest=64).collect()
    tokenizer = Tokenizer.from_file(PATH)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == set(TEXTS)
    assert len({r.sequence_id for r in rows}) == len(rows)
    for k, text in TEXTS.items():
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(by[k], key=lambda r: r.start)
        assert [i for r in own for i in r.ids] == want, k
        for r in own:
            assert r.length == len(r.ids) and r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0
            assert r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes())


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 2047, 2048, 5000])
def test_decomposition(n):
    parts = decomposed(n, 2048)
    assert sum(parts) == n and all(p & (p - 1) == 0 for p in parts)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def own_ids(texts: list, words: Words) -> list[list[int]]:
    ids, first = encoded(*S.text_bytes(pa.array(texts)), words)
    return [ids[s:e].tolist() for s, e in zip(first, first[1:])]


def test_letters_that_compose_only_once_they_are_lower_cased():
    texts = ["J\u030c aJ\u030c H\u0331 T\u0308 W\u030a Y\u030a", "<|endoftext|>J\u030c", "É\u0323 é\u0323 E\u0301 Ü\u0304"]
    tokenizer = Tokenizer.from_file(PATH)
    assert own_ids(texts, Words(PATH)) == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_words_of_latin_1_letters_are_split_and_encoded_together():
    texts = ["Été, ÉTÉ; naïve-Ärger 12é34 ÀÖØÞßàöøþÿ", "plain words, 2024 #*$", "", "ö" * 700, " ".join(f"w{chr(0xE0 + i % 23)}{i}" for i in range(2000))]
    tokenizer, words = Tokenizer.from_file(PATH), Words(PATH)
    want = [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    singly, words.singly = words.singly, lambda x: singly(x) if not x else pytest.fail(f"encoded singly: {x[:9]}")
    assert own_ids(texts, words) == want
    assert own_ids(["a×b", "a÷b Ö×Ö", "it's"], Words(PATH)) == [tokenizer.encode(x, add_special_tokens=False).ids for x in ("a×b", "a÷b Ö×Ö", "it's")]


def test_a_file_with_another_splitter_is_not_taken_apart():
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert Words(path).plain is None and Words(PATH).plain is not None


def test_words_that_go_whole_cost_no_more_than_others():
    def took(word: str) -> float:
        data, offs = S.text_bytes(pa.array([f"{word} " * 60_000]))
        times = []
        for _ in range(3):
            began = time.process_time()
            spans(data, offs)
            times.append(time.process_time() - began)
        return min(times)

    assert took("naĭve") < 4 * took("naixve")
