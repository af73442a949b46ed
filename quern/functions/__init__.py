"""Scalar function families, as names of Spark's built-in functions.

Nothing here adds a function: every family is Spark SQL's own and runs in generated code. The table serves tests and
documentation.
"""

#: Family -> Spark SQL functions.
FAMILIES = {
    "nested": ["array", "array_contains", "array_distinct", "array_except", "array_intersect", "array_join", "array_max", "array_min", "array_position", "array_remove", "array_repeat", "array_sort", "array_union", "arrays_overlap", "cardinality", "element_at", "explode", "flatten", "map_concat", "map_entries", "map_from_arrays", "map_keys", "map_values", "named_struct", "sequence", "size", "slice", "try_element_at"],
    "string": ["ascii", "btrim", "chr", "concat", "concat_ws", "contains", "endswith", "initcap", "instr", "left", "levenshtein", "lower", "lpad", "ltrim", "repeat", "replace", "right", "rpad", "rtrim", "split_part", "startswith", "substr", "substring", "translate", "trim", "upper"],
    "datetime": ["date_add", "date_format", "date_from_unix_date", "date_part", "date_sub", "date_trunc", "datediff", "dayofweek", "extract", "from_unixtime", "last_day", "make_date", "months_between", "timestamp_micros", "timestamp_millis", "timestamp_seconds", "to_date", "to_timestamp", "trunc", "unix_date", "unix_micros"],
    "encoding": ["base64", "decode", "encode", "hex", "unbase64", "unhex"],
    "regex": ["regexp_count", "regexp_extract", "regexp_extract_all", "regexp_instr", "regexp_like", "regexp_replace", "regexp_substr", "rlike", "split"],
    "crypto": ["crc32", "md5", "sha", "sha1", "sha2", "xxhash64"],
    "unicode": ["bit_length", "char_length", "character_length", "length", "octet_length", "position", "reverse", "substring_index"],
    "math": ["abs", "acos", "asin", "atan", "atan2", "cbrt", "ceil", "cos", "cot", "degrees", "exp", "factorial", "floor", "greatest", "least", "ln", "log10", "log2", "mod", "pi", "power", "radians", "rand", "round", "sign", "signum", "sin", "sqrt", "tan"],
}
