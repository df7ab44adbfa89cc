"""Thresholds, name hints, tokens and severities of the quality rubric."""

# They must equal the rubric's for the same results.
NA_STRINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
MISSING_LIMIT = 0.05
IMPUTE_LIMIT = 0.20
MODE_SHARE = 0.40
NUMERIC_AS_TEXT = 0.8
DATE_SHARE = 0.5
CATEGORY_RATIO = 0.5
PROSE_LENGTH = 200
PLACEHOLDER_LIMIT = 0.5
ROW_LOSS = 0.20
DUPLICATE_COLUMN = 0.95
HYPOTHESIS_ROWS = 20
PAIRS = 10
ID_HINTS = ["id", "code", "key"]
NUMERIC_HINTS = ["count", "qty", "quantity", "amount", "price", "value", "total", "age"]
DATE_HINTS = ["date", "time"]
ZIP_HINTS = ["zip", "postal", "postcode"]
ROW_INDEX_NAMES = ["index", "row_id", "rownum", "row_number"]
PLACEHOLDERS = ["9999", "999", "-1", "tbd", "unknown", "missing", "xxx", "n/a", "na", "null", "none"]
BOOLEAN_FAMILIES = [["y", "n"], ["yes", "no"], ["true", "false"], ["1", "0"], ["t", "f"]]
TRUE_TOKENS = ["y", "yes", "true", "1", "t"]
FALSE_TOKENS = ["n", "no", "false", "0", "f"]
DATE_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "MM-dd-yyyy"]
TIME_FORMATS = ["yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"]
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
CURRENCY = r"^\s*[$€£¥]\s*[+-]?[\d,]*\.?\d+\s*$"
UNIT = r"^\s*[+-]?[\d,]*\.?\d+\s*(kg|g|lb|lbs|cm|mm|km|mi|oz|%)\s*$"
LOCALE_US = r"^-?\d{1,3}(,\d{3})+\.\d+$"
LOCALE_EU = r"^-?\d{1,3}(\.\d{3})+,\d+$"
FLOAT_NOISE = r"\.\d*(0{5,}|9{5,})\d?$"
FORMULA = r"^=\s*[A-Za-z]+\s*\("
SHEET_ERRORS = ["#DIV/0!", "#REF!", "#VALUE!", "#NAME?", "#NULL!", "#NUM!"]
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
BULLETS = "[•◦▪‣●∙]"
DELIMITERS = [",", ";", "|"]
TIME_OF_DAY = r"\d{1,2}:\d{2}"
FAIL = "fail"
WARN = "warn"
SEVERITY = {
    "encoding": FAIL, "ragged_rows": FAIL, "bom": FAIL, "unmatched_quote": FAIL, "repeated_header": FAIL, "duplicate_rows": FAIL, "duplicate_keys": FAIL,
    "numeric_as_text": FAIL, "mixed_date_formats": FAIL, "negative_values": FAIL, "out_of_range_dates": FAIL, "placeholder_tokens": FAIL, "lost_leading_zeros": FAIL,
    "locale_mix": FAIL, "spreadsheet_formula": FAIL, "spreadsheet_error": FAIL, "dangling_refs": FAIL, "duplicate_column": FAIL, "composite": FAIL,
    "header_issues": WARN, "header_special": WARN, "control_characters": WARN, "trailing_empty": WARN, "missing": WARN, "categorical_variants": WARN,
    "whitespace_noise": WARN, "prose_noise": WARN, "boolean_families": WARN, "currency_units": WARN, "float_noise": WARN, "delimiter_mix": WARN, "granularity_mix": WARN,
}
#: Categories whose treatment must not change the number of rows.
ISSUES = "table string, category string, severity string, column string, affected bigint, total bigint, fraction double, detail map<string,string>"
