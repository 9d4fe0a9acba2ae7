"""Small sites for the tests on page bodies."""

import random

WORDS = [f"{a}{b}" for a in "river stone garden market signal window copper lantern meadow harbour".split() for b in ("", "ing", "ed", "s", "er")]


def body(seed, sentences=6, length=12):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(length)).capitalize() + "." for _ in range(sentences)]


def html(paragraphs, title="A page", share="Share this page with a friend", lang="en", byline="Written by Ana Bell", extra=""):
    main = "".join(f"<p>{p}</p>\n" for p in paragraphs)
    return (
        f'<html lang="{lang}"><head><title>{title} | Site</title></head><body><nav class="m"><ul><li>Home</li><li>About us</li></ul></nav>'
        f'<div class="c"><h1>{title}</h1><p>{byline}</p>{main}<p>{share}</p></div>'
        f'<footer><p>All rights reserved by the site owners.</p></footer>{extra}</body></html>'
    )


def site(n=12, host="a.example"):
    """Rows of ``page_id, page_url, html``."""
    return [(i, f"https://www.{host}/x/{i}", html(body(i), title=f"Title {i}")) for i in range(1, n + 1)]
