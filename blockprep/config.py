"""Settings shared by preparation and filling."""

from __future__ import annotations

from dataclasses import dataclass

# The chat marks and special tokens, in id order.  Ids 0-4 are
# reserved for them; corpus tokens follow from FIRST_CORPUS_ID.
MASK_TOKEN = "|<MASK>|"
EOS_TOKEN = "<|endoftext|>"
UNKNOWN_TOKEN = "<unk>"
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>"
SPECIAL_TOKENS = [
    (MASK_TOKEN, 0),
    (EOS_TOKEN, 1),
    (UNKNOWN_TOKEN, 2),
    (TURN_START, 3),
    (TURN_END, 4),
]
FIRST_CORPUS_ID = 5

# Label for "no loss here", and the additive value of an
# invisible key (the smallest finite half-precision number).
IGNORE_LABEL = -100
INVISIBLE = -65504.0

# Version text stamped next to prepared data: labels sit at the masked
# position and the one-step shift belongs to the loss.
LABEL_SHIFT = "shift-in-loss"

# A vocabulary of up to this many tokens is broadcast and numbered in one task; a
# larger one is numbered by ranges and met by ``heavy_join``.
BROADCAST_VOCAB = 1_000_000
# The name of a byte's row in a vocabulary: longer than any token, so that no text has it.
BYTE_NAME = "<|one byte of a token that has no id: %s|>"
VOCAB_SCHEMA = "token string, token_id int, is_special boolean"


@dataclass(frozen=True)
class PrepConfig:
    """Scalar settings; one instance is passed to every operator that needs one."""

    # The defaults up to ``context_length``.
    base_name: str = "corpus"
    mask_token: str = MASK_TOKEN
    block_size: int = 32
    sub_block_size: int = 8
    max_new_tokens: int = 256
    threshold: float = 0.9
    temperature: float = 0.0
    top_p: float = 0.95
    context_length: int = 2048
    pad_to_context: bool = True
    micro_batch: int = 1
    seed: int = 42
    vocab_size: int = 32_000
    mask_id: int = 0
    eos_id: int | None = 1
    unknown_id: int = 2
    pad_id: int | None = None
    bos_id: int | None = None
    #: Tokens outside the vocabulary become the ids of their bytes, so that none is lost.
    byte_fallback: bool = True

    def __post_init__(self) -> None:
        for name in ("block_size", "sub_block_size", "context_length", "micro_batch"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if not 0 < self.vocab_size < 2**29:
            raise ValueError("vocab_size must be above 0 and below 2^29, so that ids stay small whole numbers")
        if not 0 < self.top_p <= 1 or self.threshold < 0 or self.max_new_tokens < 0:
            raise ValueError("top_p is in (0, 1]; threshold and max_new_tokens are not below 0")
        marks = [i for i in (self.mask_id, self.eos_id, self.unknown_id) if i is not None]
        if len(set(marks)) < len(marks) or min(marks) < 0:
            raise ValueError("mask, end and unknown ids must differ and not be below 0")

    @property
    def byte_base(self) -> int:
        """The id of byte 0: byte ids follow the places of a whole vocabulary."""
        return FIRST_CORPUS_ID + self.vocab_size

    @property
    def padding_id(self) -> int | None:
        """The pad id, which defaults to end-of-sequence."""
        return self.eos_id if self.pad_id is None else self.pad_id
