import numpy as np
import pytest
from hypothesis import given, strategies as st
from vectide.functions.parse import VectorError, format_vec, parse_f32, parse_i8


@pytest.mark.parametrize(
    ("text", "out"),
    [
        ("[1,]", "[1]"), ("[1,,3]", "[1,3]"), ("[1,2,3]9", "[1,2,3]"), (" \t[1 2\n3]", "[1,2,3]"), ("[1-2]", "[1,-2]"),
        ("[1.5e38]", "[1.5e+38]"), ("[1e-46]", "[0]"), ("[0x10]", "[16]"), ("[inf,-inf,nan]", "[inf,-inf,nan]"), ("[.5,5.]", "[0.5,5]"),
    ],
)
def test_grammar(text, out):
    assert format_vec(parse_f32(text)) == out


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("1,2", "vec: expected '[' at start, got '1,2'"), ("", "vec: expected '[' at start, got ''"), ("[1,2", "vec: unterminated vector, expected ']'"),
        ("[]", "vec: empty vector not allowed"), ("[,]", "vec: empty vector not allowed"), ("[1a]", "vec: invalid float value 'a]'"), ("[1f]", "vec: invalid float value 'f]'"),
    ],
)
def test_errors(text, message):
    with pytest.raises(VectorError) as e:
        parse_f32(text)
    assert str(e.value) == message


def test_int8():
    assert parse_i8("[1, -128 127]").tolist() == [1, -128, 127]
    for bad in ("[128]", "[-129]", "[1.5]", "[]"):
        with pytest.raises(VectorError):
            parse_i8(bad)


@given(st.lists(st.floats(width=32, allow_nan=False, allow_infinity=False), min_size=1, max_size=20))
def test_format_then_parse_is_stable(values):
    once = format_vec(parse_f32(format_vec(np.array(values, np.float32))))
    assert format_vec(parse_f32(once)) == once
