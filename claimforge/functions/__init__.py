from claimforge.functions.draws import (
    bucket_of,
    draw,
    draw_mod,
    draw_unit,
    hash_key,
    hex_to_u32,
    py_draw,
    py_hash_key,
)
from claimforge.functions.text import (
    fill_template,
    format_1f,
    model_short_name,
    parse_percent,
    prompt_slots,
    render_prompt,
    replace_word,
    shuffle_words,
    word_count,
    words,
)

__all__ = [
    "bucket_of", "draw", "draw_mod", "draw_unit", "hash_key", "hex_to_u32", "py_draw", "py_hash_key",
    "fill_template", "format_1f", "model_short_name", "parse_percent", "prompt_slots", "render_prompt",
    "replace_word", "shuffle_words", "word_count", "words",
]
