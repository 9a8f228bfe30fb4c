"""Pages with tags left out or out of order, and context words of personal data."""

import pytest

from tidemark.llm import media, pii


def seen(page):
    return [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in media.sequence(page)]


PAGES = {
    "<html><head><title>x</title><body><p>Hello world</p></body></html>": [("text", "Hello world", None)],
    "<head><meta charset=utf-8><link rel=x><style>p {}</style><p>One<p>Two": [("text", "One", None), ("text", "Two", None)],
    "<head><title>x</title>\n  words at once <img src=a>": [("text", "words at once", None), ("media", "a", None)],
    "<head><script>var a = '<p>no</p>';</script></head><p>yes</p>": [("text", "yes", None)],
    "<figure><img src=a><figcaption>cap</figure><p>After text</p><img src=b>": [("media", "a", "cap"), ("text", "After text", None), ("media", "b", None)],
    "<figure><figcaption>first</figcaption><img src=a></figure>": [("media", "a", "first")],
    "<figure><img src=a alt=x><figure><img src=b alt=y><figcaption>inner</figcaption></figure><figcaption>outer</figcaption></figure>": [("media", "a", "outer"), ("media", "b", "inner")],
    "<figure><img src=a alt=x><figure><img src=b alt=y></figure><figcaption>outer": [("media", "a", "outer"), ("media", "b", "y")],
    "<figure><img src=a><figcaption><p>two</p><p>parts</p></figcaption>text in it</figure>": [("media", "a", "two parts"), ("text", "text in it", None)],
    "<figcaption>alone</figcaption><img src=a alt=z>": [("text", "alone", None), ("media", "a", "z")],
    "</figure></figcaption></head>a<br>b": [("text", "a", None), ("text", "b", None)],
    "<noscript><img src=hidden></noscript>shown<template><p>t</p></template>": [("text", "shown", None)],
    "<img alt=nosource><video src=v></video>": [("media", "v", None)],
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert seen(page) == PAGES[page]


def kinds(text):
    return [k for _, k, _ in pii.spans(text)]


IBAN = "DE89 3704 0044 0532 0130 00"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SSN 123-45-6789", ["ssn"]), ("SSN 123-45-6789 \u0130", ["ssn"]), ("\u0130" * 60 + " ssn: 123-45-6789", ["ssn"]), ("lessness 123-45-6789", []), ("ssns 123-45-6789", []),
        (f"conversion {IBAN}", ["iban"]), (f"serialized {IBAN}", ["iban"]), (f"serial {IBAN}", []), (f"Version: {IBAN}", []), (f"{IBAN} part number", []), (f"serial iban {IBAN}", ["iban"]),
        ("ssn" + " " * 47 + "123-45-6789", []), ("ssn" + " " * 45 + "123-45-6789", ["ssn"]), ("xssn" + " " * 45 + "123-45-6789", []),
        ("123-45-6789" + " " * 45 + "ssn", ["ssn"]), ("123-45-6789" + " " * 45 + "ssnx", []), ("123-45-6789" + " " * 46 + "ssn", []),
    ],
)
def test_context_words_are_whole(text, want):
    assert kinds(text) == want
