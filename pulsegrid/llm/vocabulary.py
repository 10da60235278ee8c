"""What a tokenizer file says, as plain data: ids, merges, special strings. The file's path is always a parameter."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the
    others for the letters from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in own else spare))
        spare += b not in own
    return out


LETTERS = byte_letters()
TO_LETTERS = {b: c for b, c in enumerate(LETTERS)}


def letters(data: bytes) -> str:
    return data.decode("latin-1").translate(TO_LETTERS)


@dataclass(frozen=True)
class Vocabulary:
    ids: dict[str, int]
    merges: list[tuple[str, str]]
    specials: dict[str, int] = field(default_factory=dict)
    suffix: str = ""

    @cached_property
    def ranks(self) -> dict[tuple[int, int], int]:
        """(left id, right id) -> rank."""
        out: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(self.merges):
            out.setdefault((self.ids[a], self.ids[b]), rank)
        return out

    @cached_property
    def rank_pairs(self) -> list[tuple[int, int]]:
        """The pair of ids that each rank merges."""
        return [(self.ids[a], self.ids[b]) for a, b in self.merges]

    @cached_property
    def made(self) -> list[int]:
        """The id of the token that each rank's merge makes."""
        return [self.ids[a + b] for a, b in self.merges]

    @cached_property
    def tokens(self) -> list[str]:
        """Token strings by id, special ones included."""
        out = [""] * (1 + max([*self.ids.values(), *self.specials.values()]))
        for token, i in {**self.ids, **self.specials}.items():
            out[i] = token
        return out

    def merges_ascend(self) -> bool:
        """Whether the parts of every pair are bytes or made by earlier merges, and no token is made by two merges. Then no merge
        can bring up a pair of lower rank than its own."""
        rank_of = {i: rank for rank, i in enumerate(self.made)}
        return len(rank_of) == len(self.made) and all(rank_of.get(part, -1) < rank for pair, rank in self.ranks.items() for part in pair)


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model = data["model"]
    if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("unk_token"):
        raise ValueError(f"{path} is not a byte-level BPE vocabulary")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    specials = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
    return Vocabulary(model["vocab"], merges, specials, model.get("end_of_word_suffix") or "")
