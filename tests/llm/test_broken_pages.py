"""Pages with broken or unusual markup."""

import time

from framelake.llm.html_text import main_text

PROSE = "The harbour was quiet that morning, and nobody on the long stone pier expected the ferry to arrive before noon."


def test_a_slash_ends_no_script():
    page = f'<article><p>{PROSE}</p><script src="a.js" />var leak = 1;</script><p>{PROSE}</p></article>'
    assert main_text(page) == f"{PROSE}\n{PROSE}"


def test_text_of_formulas_stays():
    page = f"<article><p>{PROSE} Here <math><mi>x</mi><mo>=</mo><mn>5</mn></math> holds.</p></article>"
    assert main_text(page) == f"{PROSE} Here x=5 holds."


def test_unclosed_and_unopened_tags_take_linear_time():
    began = time.process_time()
    for pair in ("<b>x</i>", "<div><b></i><p>x"):
        main_text(f"<article><p>{PROSE}</p>" + pair * 20_000)
    assert time.process_time() - began < 20


def test_an_end_tag_closes_the_nearest_of_its_name():
    page = f"<article><div><b><p>{PROSE}</b></p></section></div><p>{PROSE}</article><footer><p>{PROSE}</p></footer>"
    assert main_text(page) == f"{PROSE}\n{PROSE}"
