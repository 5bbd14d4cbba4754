"""Column expressions. Nothing here starts a job."""

from glosswork.functions.arrays import (
    argmax,
    dot,
    flattened,
    let,
    log_softmax,
    one_based,
    pad_to,
    running_total,
    softmax,
    sum_squares,
    whole_div,
)
from glosswork.functions.draws import HEX_SPAN, draw, draw_slice, threshold
from glosswork.functions.text import (
    fill_slots,
    join_words,
    letter_index,
    snippet,
    strip,
    token_pieces,
    tokens,
    words,
)

__all__ = [
    "HEX_SPAN",
    "argmax",
    "dot",
    "draw",
    "draw_slice",
    "fill_slots",
    "flattened",
    "join_words",
    "let",
    "letter_index",
    "log_softmax",
    "one_based",
    "pad_to",
    "running_total",
    "snippet",
    "softmax",
    "strip",
    "sum_squares",
    "threshold",
    "whole_div",
    "token_pieces",
    "tokens",
    "words",
]
