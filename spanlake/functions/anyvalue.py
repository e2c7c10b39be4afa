"""Attribute values of the wire format as text.

An attribute value is one of string, bool, int, double, bytes, array or key-value list, nested to any
depth.  Spark structs cannot recurse, so a value is parsed three levels at a time: what lies deeper first
stays JSON between two marks, and is then parsed and rendered in turn until no mark is left.  Values
without deeper levels, nearly all, cost one look for a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

DEPTH = 3
#: Marks around JSON that is not rendered yet: noncharacters, which no text in exchange may hold.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"


def any_value_type(depth: int = DEPTH) -> T.StructType:
    """Schema of a JSON-encoded attribute value with ``depth`` levels of nesting."""
    fields = [
        T.StructField("stringValue", T.StringType()),
        T.StructField("boolValue", T.BooleanType()),
        T.StructField("intValue", T.StringType()),
        T.StructField("doubleValue", T.DoubleType()),
        T.StructField("bytesValue", T.StringType()),
    ]
    if depth > 1:
        inner = any_value_type(depth - 1)
        pair = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", inner)])
        fields += [
            T.StructField("arrayValue",
                          T.StructType([T.StructField("values", T.ArrayType(inner))])),
            T.StructField("kvlistValue",
                          T.StructType([T.StructField("values", T.ArrayType(pair))])),
        ]
    else:  # a text field takes nested JSON as it is
        fields += [T.StructField("arrayValue", T.StringType()),
                   T.StructField("kvlistValue", T.StringType())]
    return T.StructType(fields)


KEY_VALUES = T.ArrayType(T.StructType([
    T.StructField("key", T.StringType()), T.StructField("value", any_value_type())]))


_EXPONENT = "'^-?([0-9])[.]([0-9]+)E(-?[0-9]+)$'"


def _double_sql(x: str) -> str:
    """Decimal text without exponent; integral values carry no fraction.

    An exponent is undone by moving the point within the digits, so none is lost at any size.
    """
    text = f"CAST({x} AS STRING)"
    digits = (f"concat(regexp_extract({text}, {_EXPONENT}, 1), "
              f"regexp_replace(regexp_extract({text}, {_EXPONENT}, 2), '^0$', ''))")
    power = f"CAST(regexp_extract({text}, {_EXPONENT}, 3) AS INT)"
    return f"""CASE
        WHEN {x} IS NULL THEN NULL WHEN isnan({x}) THEN 'NaN'
        WHEN {x} = double('Infinity') THEN 'inf' WHEN {x} = double('-Infinity') THEN '-inf'
        WHEN abs({x}) < 1e15D AND {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS STRING)
        WHEN NOT contains({text}, 'E') THEN {text}
        ELSE concat(IF({x} < 0, '-', ''), CASE
            WHEN abs({x}) < 1 THEN concat('0.', repeat('0', -{power} - 1), {digits})
            WHEN length({digits}) <= {power} + 1 THEN rpad({digits}, {power} + 1, '0')
            ELSE concat(substring({digits}, 1, {power} + 1), '.', substring({digits}, {power} + 2)) END) END"""


def _value_sql(v: str, depth: int) -> str:
    """SQL of the text of the attribute value that the SQL ``v`` names."""
    parts = [f"{v}.stringValue", f"CAST({v}.boolValue AS STRING)", f"{v}.intValue",
             _double_sql(f"{v}.doubleValue"), f"lower(hex(unbase64({v}.bytesValue)))"]
    if depth > 1:
        item, pair = f"i{depth}", f"p{depth}"
        parts += [
            f"IF({v}.arrayValue IS NULL, NULL, concat('[', coalesce(array_join(transform("
            f"{v}.arrayValue.values, {item} -> {_value_sql(item, depth - 1)}), ','), ''), ']'))",
            f"IF({v}.kvlistValue IS NULL, NULL, concat('{{', coalesce(array_join(transform("
            f"{v}.kvlistValue.values, {pair} -> concat({pair}.key, '=', "
            f"{_value_sql(pair + '.value', depth - 1)})), ','), ''), '}}'))"]
    else:
        parts += [f"""concat('{_OPEN}{{"{kind}":', {v}.{kind}, '}}{_CLOSE}')""" for kind in ("arrayValue", "kvlistValue")]
    return f"coalesce({', '.join(parts)}, '')"


def _whole_sql(text: str) -> str:
    """SQL of a text with all that is still JSON in it rendered, three levels in each round.

    There are at most as many rounds as nested values; a round without marks does nothing.
    """
    kind = any_value_type().simpleString()
    some = _value_sql("v_", DEPTH)
    value = (f"""transform(array(from_json(substring_index(part_, '{_CLOSE}', 1), '{kind}')), v_ -> {some})[0]""")
    after = f"substring(part_, length(substring_index(part_, '{_CLOSE}', 1)) + 2)"
    one = (f"""concat(split(acc_, '{_OPEN}')[0], array_join(transform(slice(split(acc_, '{_OPEN}'), 2, """
           f"""length(acc_)), part_ -> concat({value}, {after})), ''))""")
    rounds = f"""sequence(1, greatest(1, size(split({text}, 'Value"'))))"""
    return f"""IF(instr({text}, '{_OPEN}') = 0, {text},
        aggregate({rounds}, {text}, (acc_, round_) -> IF(instr(acc_, '{_OPEN}') = 0, acc_, {one})))"""


def any_value_text(column: str) -> Column:
    """Text of the attribute value in a named column; '' when it is missing."""
    return F.expr(f"transform(array({_value_sql(column, DEPTH)}), t_ -> {_whole_sql('t_')})[0]")


def text_pairs(pairs: str) -> Column:
    """Key-value pairs of a named column, values as text (``key``, ``text`` structs)."""
    first = f"transform({pairs}, p -> named_struct('key', p.key, 'text', {_value_sql('p.value', DEPTH)}))"
    return F.expr(f"""coalesce(transform({first}, q_ -> named_struct('key', q_.key, 'text',
        {_whole_sql('q_.text')})), array())""")


def last_text(pairs: Column, key: str) -> Column:
    """Text of the last pair with ``key`` out of :func:`text_pairs`; null without one."""
    return F.get(F.reverse(F.filter(pairs, lambda p: p["key"] == key)), 0)["text"]
