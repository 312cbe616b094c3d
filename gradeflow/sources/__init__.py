"""Readers: files to DataFrames with a stated schema."""

from .delimited import read_csv, read_tsv
from .documents import (
    parse_json_lines,
    read_json,
    read_jsonl,
    read_parquet,
    read_stop_words,
    stop_word_filter,
    stop_word_list,
)
from .lines import attach_line_labels, read_numbered_lines
from .paths import exclude_paths, resolve
from .scores import read_scores, read_scores_json, valid_scores
from .weights import Node, flatten_weights, load_weights, weights_frame
