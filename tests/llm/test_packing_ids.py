"""Ids of packed documents are those of the JSON tokenizer as it comes."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from paperloom.llm import packing
from paperloom.llm.queries import tokenizer_path

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\ny", "<|endoftext |>", "<|endoftext|", "plain  words"]


def test_end_of_text_is_one_token(spark):
    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = [e.ids for e in plain.encode_batch(TEXTS, add_special_tokens=False)]
    assert want[0] == [64, 220, 50256, 275]
    for kind in ("json", "tiktoken"):
        assert packing.encoder(tokenizer_path(f"byte_bpe_50k.{kind}"))(TEXTS) == want
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.tiktoken")).collect()}
    for k, ids in enumerate(want):
        assert (rows[k]["doc_tokens"], rows[k]["ids_crc32"]) == (len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes()))
