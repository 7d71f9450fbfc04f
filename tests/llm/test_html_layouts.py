"""Pages in layouts that the labeller's training recipe does not write, and the reader's edge cases."""

import random
import time

import pytest

from polytrace.llm import html

WORDS = "the river runs past old mill town and people walk slowly along its banks where tall trees grow in spring while birds sing over green fields near stone bridge".split()


def sentence(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(6, 18))).capitalize() + "."


def paragraphs(p):
    return "".join(f"<p>{x}</p>" for x in p)


LAYOUTS = {
    "bare": lambda t, p: f"<body><h1>{t}</h1>{paragraphs(p)}</body>",
    "nav and footer": lambda t, p: f"<body><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav><h1>{t}</h1>{''.join(f'<p>{x}' for x in p)}<footer>&copy; 2021 The Site. All rights reserved.</footer></body>",
    "two plain divs": lambda t, p: f"<body><div><div><h1>{t}</h1>{paragraphs(p)}</div></div></body>",
    "two cells": lambda t, p: f"<body><table><tr><td><a href=/>Home</a><br><a href=/c>Contact</a></td><td><h1>{t}</h1>{paragraphs(p)}</td></tr></table></body>",
    "three cells": lambda t, p: f"<body><table><tr><td colspan=3><a href=/>Example Site</a></td></tr><tr><td><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></td><td><h2>{t}</h2>{paragraphs(p)}</td><td>Advertisement: buy now</td></tr></table></body>",
    "own elements": lambda t, p: f"<body><x-top><a href=/>Home</a> <a href=/c>Contact</a></x-top><x-story><x-head>{t}</x-head>{''.join(f'<x-par>{x}</x-par>' for x in p)}</x-story></body>",
    "generated names": lambda t, p: f"<body><div class='css-a81 sc-bdf'><div class='css-9z'><a href=/>Home</a><a href=/x>Sport</a></div><div class='css-kk1'><h1 class=css-h>{t}</h1>{''.join(f'<div class=css-p>{x}</div>' for x in p)}</div></div></body>",
    "fifteen divs deep": lambda t, p: f"<body>{'<div>' * 15}<h1>{t}</h1>{paragraphs(p)}{'</div>' * 15}<div class=footer><a href=/p>Privacy</a></div></body>",
    "deep in an article": lambda t, p: f"<body><article>{'<div><div>' * 6}<h1>{t}</h1>{paragraphs(p)}{'</div></div>' * 6}</article><aside><h3>Related</h3><ul><li><a href=/1>Other stories here</a></ul></aside></body>",
    "fieldset": lambda t, p: f"<body><div><a href=/>Home</a> &gt; <a href=/s>Stories</a></div><fieldset><h1>{t}</h1>{''.join(f'<dd>{x}</dd>' for x in p)}</fieldset></body>",
    "comments below": lambda t, p: f"<body><div><h1>{t}</h1>{paragraphs(p)}</div><div class=comments><p>{p[0][::-1]}</p><p>Nice words.</p></div></body>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts_held_out_of_training(name):
    rng, whole, missed, extra, blocks = random.Random(7), 0, 0, 0, 0
    for _ in range(40):
        title, text = sentence(rng)[:30].strip(" ."), [" ".join(sentence(rng) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 7))]
        got, want = html.extract([LAYOUTS[name](title, text)], html.fitted())[0].split("\n\n"), [title, *text]
        whole += got == want
        missed += sum(x not in got for x in want)
        extra += sum(x not in want for x in got)
        blocks += len(want)
    print(name, whole, missed, extra, blocks)
    assert whole >= 34 and missed <= 0.03 * blocks and extra <= 0.03 * blocks


def test_probes():
    text = "<h1>The river</h1><p>It rises in the hills, and runs to the sea.</p><p>Boats use it in summer. In winter they rest.</p>"
    want = "The river\n\nIt rises in the hills, and runs to the sea.\n\nBoats use it in summer. In winter they rest."
    pages = [f"<body>{text}</body>", f"<body><nav><a href=/>Home</a></nav>{text}<footer>&copy; 2024 Example</footer></body>", f"<body><div><div>{text}</div></div></body>", f"<table><tr><td><a href=/>Home</a><td>{text}</table>"]
    assert html.extract(pages, html.fitted()) == [want] * 4


def texts(page):
    return [b.text for b in html.blocks_of(page)]


def test_silent_elements_leak_nothing():
    assert texts("<p>one</p><script>var s='<!--';</script><p>two</p><div class=footer>foot</div>") == ["one", "two", "foot"]
    assert texts("<style>a:before{content:'<!--'}</style><p>two</p>") == ["two"]
    assert texts("<p>a<script>if (x</script >b</p><SCRIPT>z</ScRiPt>c") == ["ab", "c"]
    assert texts("one<script>never ends <p>two") == ["one"]
    assert texts("one<select><p>two</p>") == ["one", "two"]  # an end that never comes
    assert texts("x <math><mi>a</mi><mo>=</mo><mi>b</mi></math> y<noscript>n</noscript><object>o</object>") == ["x a=b y", "n", "o"]
    assert texts("<svg viewBox='0'><path d='M0'/><text>label</text></svg><p>after</p>") == ["label", "after"]


def test_tags_cut_short_and_odd_quotes():
    assert texts("<p it's>one</p><p title=\"a>b\">two</p>") == ["one", "two"]
    assert texts("<p title=\"never closed>one</p><p>two</p>") == ["one", "two"]
    assert texts("3 < 4 <5 << six <p>seven <b") == ["3 < 4 <5 << six", "seven <b"]
    assert texts("<!DOCTYPE html><?xml version='1'?>a<!-- b --> c<!-- d") == ["a c"]


@pytest.mark.parametrize("piece", ["<a ", "<a '", "<a '>'", "<a =\"", "<x>", "</x>", "<select>", "<!--", "<script", "</script", "<", "&", "<x1>y</x2>", "<p><div></p>"])
def test_reading_takes_time_in_proportion(piece):
    def seconds(n):
        page, began = piece * (n // len(piece)) + '"', time.process_time()
        html.blocks_of(page)
        return time.process_time() - began

    small, large = seconds(100_000), seconds(800_000)
    assert large < 1 or large < 24 * small  # eight times the page; its square would be 64
