from carledger.functions.timefn import (  # noqa: F401
    add_days, fmt17, micros_between, plus_one_day, trunc_seconds, ts_diff,
)
from carledger.functions.exact import (  # noqa: F401
    cents, exact_days_money, money_of_price_days, ratio_decimal, round_ratio,
    round_ratio_up, units_to_decimal,
)
