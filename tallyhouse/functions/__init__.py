from tallyhouse.functions.dates import days_between, month_end, month_name
from tallyhouse.functions.numbers import average, money, percent, ratio
from tallyhouse.functions.text import sentence_case, text_length

__all__ = [
    "average", "days_between", "money", "month_end", "month_name",
    "percent", "ratio", "sentence_case", "text_length",
]
