from .scalar import (  # noqa: F401
    c_of,
    decision_label,
    fixed,
    logistic,
    name_map,
    path_norm,
    percent_text,
    reason_text,
    reason_texts,
    round_to,
    sentence,
    three_decimals,
    zscore,
)
