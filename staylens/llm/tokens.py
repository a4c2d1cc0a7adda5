"""Token counts by a public tokenizer; the vocabulary file stays where it is installed.

The vocabulary comes from the installed package ``public_tokenizers``, or from any ranks file whose path
is given; only the former needs the package, whose word pattern is used where it is there.
"""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark.sql import SparkSession


#: Words, figures, signs and blanks, where no pattern comes with the vocabulary.
WORDS = r"\s?\p{L}+|\s?\p{N}{1,3}|\s?[^\s\p{L}\p{N}]+|\s+"


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """Path of an installed vocabulary file; every operator takes another path as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(2)
def encoding(path: str):  # noqa: ANN201
    """The byte-level encoder of a ranks file, loaded once per worker process."""
    import tiktoken

    try:
        from public_tokenizers import PATTERN
    except ImportError:
        PATTERN = WORDS
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text; null and empty texts have none."""
    enc = encoding(path)
    return [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
