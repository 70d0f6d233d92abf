from .html import decode_entities, element_links, element_texts, pair_map
from .listing import coverage_score, is_model_candidate, text_features, train_text, validation_errors
from .numbers import parse_int, parse_number, parse_price, parse_token
from .text import clean_text, word_ngrams, words
from .urls import list_page_url, location_parts, property_type_from_url, resolve_url

__all__ = [
    "clean_text",
    "coverage_score",
    "decode_entities",
    "element_links",
    "element_texts",
    "is_model_candidate",
    "list_page_url",
    "location_parts",
    "pair_map",
    "parse_int",
    "parse_number",
    "parse_price",
    "parse_token",
    "property_type_from_url",
    "resolve_url",
    "text_features",
    "train_text",
    "validation_errors",
    "word_ngrams",
    "words",
]
