"""Token ids of the public byte-level vocabulary, from whichever library is faster and agrees.

``tokenizers`` defines the ids. ``tiktoken`` holds the same merges and is several times
as fast; it is used for texts of ASCII, Latin and punctuation characters, where the two
libraries' Unicode tables can't differ, that hold none of the vocabulary's special
strings. All other texts go to ``tokenizers``.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Encoder of texts by a ``tokenizers`` file, without added special tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_path):
        return lambda texts: [x.ids for x in slow.encode_batch_fast(texts, add_special_tokens=False)]
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    with open(path, encoding="utf-8") as file:
        special = [re.escape(x["content"]) for x in json.load(file).get("added_tokens", [])]
    careful = re.compile("|".join([*special, r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-ſ‐-‧€]"]))

    def encode(texts: list[str]) -> list[list[int]]:
        return [slow.encode(t, add_special_tokens=False).ids if careful.search(t) else fast.encode_ordinary(t) for t in texts]

    return encode
