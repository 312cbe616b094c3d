"""Column functions: everything here maps Column to Column and stays inside the JVM."""

from .answers import extract_answer, extract_choice, extract_content, extract_reading, parse_score
from .canonical import canonical_json, json_string
from .logits import classify_logits
from .prompts import generation_group_key, options_text, render_prompt, to_chat_request
from .strict_json import parse_whole
from .text import (
    ascii_digits,
    bind,
    clean_text,
    dataset_name,
    format_score,
    model_name,
    ngram_keys,
    ngrams,
    preprocess,
    remove_stop_words,
    round2,
    safe_name,
    segmenter,
    strip,
    tokenize,
)

__all__ = [n for n in dir() if not n.startswith("_")]
