"""Stylesheet functions and steps, apart from Spark."""

from __future__ import annotations

from itertools import islice

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftwork.functions import calc, colors, rewrites, selectors, text, values
from weftwork.operators import atomic, modules, ordering, prefixes, trees
from weftwork.plans.stylesheets import Options, sorted_css, transformed
from weftwork.sources import css


def murmur2(data: bytes, seed: int = 0) -> int:
    """The public 32-bit MurmurHash2, byte by byte."""
    m, mask = 0x5BD1E995, 0xFFFFFFFF
    h = seed ^ len(data)
    while len(data) >= 4:
        k = int.from_bytes(data[:4], "little") * m & mask
        k = (k ^ (k >> 24)) * m & mask
        h = (h * m & mask) ^ k
        data = data[4:]
    if len(data) == 3:
        h ^= data[2] << 16
    if len(data) >= 2:
        h ^= data[1] << 8
    if data:
        h = (h ^ data[0]) * m & mask
    h = (h ^ (h >> 13)) * m & mask
    return h ^ (h >> 15)


@given(st.text(max_size=30))
def test_hash_is_murmur2_of_the_low_bytes(x):
    units = [int.from_bytes(x.encode("utf-16-le")[k : k + 2], "little") for k in range(0, 2 * len(x.encode("utf-16-le")) // 2, 2)]
    assert int(text.name_hash(x), 36) == murmur2(bytes(u & 255 for u in units))


def test_golden_class_names():
    assert atomic.class_name(None, "&", "color", "red") == "_syaz5scu"
    assert atomic.class_name("media(min-width: 30rem)", "& div", "user-select", "none") == "_195xglyw"
    assert atomic.class_name(None, "&", "color", "red", True) == atomic.class_name(None, "&", "color", "redtrue")


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_numbers_print_as_what_they_are(x):
    assert float(text.js_number(x)) == x


def test_short_names_are_all_there_is():
    got = list(islice(text.short_names(), 4000))
    assert len(set(got)) == 4000 and not any("ad" in n.lower() for n in got)
    assert [modules._short(k) for k in range(60) if "ad" not in modules._short(k)] == got[: len([k for k in range(60) if "ad" not in modules._short(k)])]
    assert next(text.short_names({"a", "b"})) == "c" and next(text.short_names(prefix="x")) == "xa"
    with pytest.raises(ValueError, match="prefix"):
        next(text.short_names(prefix="9"))


def test_lists_respect_quotes_and_parentheses():
    assert text.comma_list("a, b(c, d), 'e, f'") == ["a", "b(c, d)", "'e, f'"]
    assert text.comma_list("a,") == ["a", ""] and text.space_list(" a  b\\ c ") == ["a", "b\\ c"]


@settings(max_examples=200)
@given(st.text(alphabet="ab1 ,/()'\"\\.-+%:", max_size=25))
def test_any_value_parses_and_settles(x):
    once = values.text_of(values.parse(x))
    assert isinstance(values.rows(x), list) and isinstance(once, str)


@pytest.mark.parametrize("value,want", [("calc(1px + 1in)", "97px"), ("calc((1em - 2px) * 2)", "calc(2em - 4px)"), ("calc(1px / 0)", "calc(1px/0)"), ("calc(var(--a) * 2 + 1px)", "calc(1px + 2*var(--a))"), ("calc(1s + 500ms)", "1.5s"), ("calc(1px)", "1px"), ("calc(-1 * var(--x))", "calc(-1*var(--x))")])
def test_calc(value, want):
    assert calc.fold_calc(value) == want


@given(st.tuples(*[st.integers(0, 255)] * 3))
def test_shortest_colors_mean_the_same(rgb):
    word = colors.shortest((*rgb, 1.0))
    assert colors.rgba(values.parse(word)[0])[:3] == rgb and len(word) <= 7


@pytest.mark.parametrize("prop,value", [("margin", "0 auto"), ("transition", "opacity 1s ease"), ("border", "1px solid red"), ("width", "calc(100% - 3px)"), ("background", "url(a.png) 0 0/cover"), ("content", '"x"')])
def test_minified_values_stay(prop, value):
    assert rewrites.minified(prop, value) == value


SHEETS = ["a{color:red}", "@media print{a{color:red;top:0}}", "a{b:c;&:hover{d:e}}", "@font-face{font-family:x;src:url(y)}", "a,b>c{d:e!important}", "/*! keep */a{b:c}", "@import \"x\";a{b:c}", "a{--x:{y:z};b:c}", "a[x=\"{\"]{b:c}", ".a\\{b{c:d}"]


@pytest.mark.parametrize("sheet", SHEETS)
def test_text_round_trips(sheet):
    assert css.text_of(css.parse(css.text_of(css.parse(sheet)))) == css.text_of(css.parse(sheet))


@pytest.mark.parametrize("sheet", ["a{", "a}", "a{b}", "/* x"])
def test_broken_sheets(sheet):
    with pytest.raises(css.CssError):
        css.parse(sheet)


def test_rows_are_the_tree():
    rows = css.rows(css.parse("@media print{a{color:red}} b{top:0;left:0}"))
    assert [(r[0], r[1], r[2], r[4], r[5]) for r in rows] == [(0, None, 0, "atrule", "media"), (1, 0, 0, "rule", None), (2, 1, 0, "decl", "color"), (3, None, 1, "rule", None), (4, 3, 0, "decl", "top"), (5, 3, 1, "decl", "left")]


def test_transform():
    sheets, names = transformed("color:red;color:blue;&:hover{color:red}@media print{color:red}")
    assert [n[:5] for n in names] == ["_syaz", names[1][:5], names[2][:5]] and len(sheets) == 3
    assert sheets[0] == f".{names[0]}{{color:#00f}}" and sheets[1].startswith(f".{names[1]}:hover{{") and sheets[2].startswith("@media print{.")
    assert transformed("color:red;color:undefined")[0] == [] and transformed("") == ([], [])
    assert transformed("color:blue", Options(optimize=False))[0] == ["._syaz13q2{color:blue}"]
    assert transformed("color:red", Options(compressed={"syaz5scu": "a"})) == ([".a{color:red}"], ["_syaz5scu"])
    assert transformed("color:red", Options(hash_prefix="x"))[1] != ["_syaz5scu"]
    with pytest.raises(atomic.AtomicError):
        transformed("color:red", Options(hash_prefix="9x"))
    with pytest.raises(atomic.AtomicError):
        transformed("@charset 'x';")


def test_empty_rules_go_only_if_they_lost_something():
    assert css.text_of(css.Node("root", children=trees.each_declaration(css.parse("a{b:undefined}c{}").children, lambda d: []))) == "c{}"


def test_duplicates():
    assert sorted_css("a{b:c}d{e:f}a{b:c}") == "d{e:f}a{b:c}"
    assert sorted_css("a{b:c;g:h}a{b:c}") == "a{g:h}a{b:c}"
    assert sorted_css("@media x{a{b:c}}@media x{a{b:c}}") == "@media x{a{b:c}}"


def test_conditions():
    assert ordering.conditions("(min-width: 30em)") == [("width", ">=", 480.0)]
    assert ordering.conditions("(400px <= width)") == [("width", ">=", 400.0)]
    assert ordering.conditions("(width < 0)") == [("width", "<", 0.0)] and ordering.conditions("(width < 5)") == []
    assert ordering.conditions("min-width: 30em") == []


def test_selectors():
    assert selectors.nested(["a", "b"], ["&:hover", "c"]) == ["a:hover", "a c", "b:hover", "b c"]
    assert selectors.minify_selectors(["b ", "a  >  b", "b"]) == ["a>b", "b"]
    assert selectors.minify_selector("from", True) == "0%" and selectors.minify_selector("a:") == "a:"


def test_prefixes():
    nodes = prefixes.prefixed(css.parse("@keyframes x{to{user-select:none}}a::placeholder{b:c}").children, {"user-select": ["-webkit-", "-moz-"], "@keyframes": ["-webkit-"], "::placeholder": ["-moz-"]})
    got = css.text_of(css.Node("root", children=nodes))
    assert got.startswith("@-webkit-keyframes x{to{-webkit-user-select:none;user-select:none}}@keyframes x{")
    assert "a::-moz-placeholder{b:c}a::placeholder{b:c}" in got


def test_package_steps():
    assert modules.rewritten_package('{"a": 1}', [{"op": "renameKey", "from": "a", "to": "b", "wrap": {"as": "object", "key": "."}}]) == '{"a": 1, "b": {".": 1}}'
