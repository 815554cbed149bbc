"""Names and codes of languages as they are written in labels."""

from __future__ import annotations

import re

# ISO 639-1 code, then ISO 639-2 codes and names of the language in English and in itself.
LANGUAGES = {
    "en": "eng english",
    "de": "deu ger german deutsch",
    "fr": "fra fre french français francais",
    "es": "spa spanish castilian español espanol castellano",
    "it": "ita italian italiano",
    "pt": "por portuguese português portugues",
    "nl": "nld dut dutch flemish nederlands vlaams",
    "ru": "rus russian русский",
    "pl": "pol polish polski",
    "sv": "swe swedish svenska",
    "da": "dan danish dansk",
    "no": "nor nob nno norwegian norsk nb nn",
    "fi": "fin finnish suomi",
    "cs": "ces cze czech čeština",
    "sk": "slk slo slovak slovenčina",
    "hu": "hun hungarian magyar",
    "ro": "ron rum romanian română",
    "bg": "bul bulgarian български",
    "uk": "ukr ukrainian українська",
    "el": "ell gre greek ελληνικά",
    "tr": "tur turkish türkçe",
    "ar": "ara arabic العربية",
    "he": "heb hebrew עברית iw",
    "zh": "zho chi chinese 中文",
    "ja": "jpn japanese 日本語",
    "ko": "kor korean 한국어",
    "ca": "cat catalan català",
}

_CODES = {name: code for code, names in LANGUAGES.items() for name in (code, *names.split())}


def language_of(label: str | None) -> str | None:
    """Two-letter code that a label names: a code, a tag with region or script, or a name; None if it names none."""
    word = re.split(r"[-_.,;/( ]", (label or "").strip().lower(), maxsplit=1)[0]
    return _CODES.get(word)
