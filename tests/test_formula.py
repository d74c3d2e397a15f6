import warnings

import pytest

from seriesmill.plans.formula import FormulaError, parse


def cols(f, known=("value", "price", "date")):
    return parse(f, known).columns


@pytest.mark.parametrize(
    "term,lags",
    [("p(3)", [1, 2, 3]), ("p(2:4)", [2, 3, 4]), ("p(c(1, 7))", [1, 7]), ("p(1, 7, 12)", [1, 7, 12]), ("p(c(7, 1, 7))", [1, 7]), ("p(c(1:3, 7))", [1, 2, 3, 7]), ("p(2) + p(c(1, 5))", [1, 2, 5]), ("p(c(5))", [5])],
)
def test_lags(term, lags):
    assert cols(f"value ~ {term}") == [f"value_lag_{n}" for n in lags]


@pytest.mark.parametrize("f", ["value ~ p(0)", "value ~ p(-1)", "value ~ p(c())", "value ~ p()", "value ~ q(0)", "value ~ rollslope(1)", "value ~ nope()", "value ~ missing", "other ~ p(1)", "value ~", "value", "value ~ price:date", "value ~ p(x)", "value ~ lag(nope, 1)", "value ~ dow(3)", "value ~ trend(0)", "value ~ p(1) p(2)"])
def test_rejected(f):
    with pytest.raises(FormulaError):
        parse(f, ("value", "price", "date"))


def test_all_terms_in_order():
    f = "value ~ q(7, 28) + rollsum(7) + rollsd(3) + rollmin(2) + rollmax(2) + rollslope(5) + trend(1, 2) + dow() + month() + lag(price, 0, 2) + ma(price, 4) + price"
    assert cols(f) == ["value_ma_7", "value_ma_28", "value_rollsum_7", "value_rollsd_3", "value_rollmin_2", "value_rollmax_2", "value_rollslope_5", "trend1", "trend2", "dow", "month", "price", "price_lag_2", "price_ma_4"]


def test_target_of_a_call_and_default_trend():
    s = parse("log(value) ~ trend()", ("value",))
    assert s.target == "value" and s.columns == ["trend1"] and not s.recursive


def test_degenerate_formula_warns():
    with pytest.warns(UserWarning, match="exactly"):
        parse("value ~ p(6) + q(7)", ("value",))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        parse("value ~ p(5) + q(7)", ("value",))


def test_memory_and_exogenous():
    s = parse("value ~ p(3) + q(9) + lag(price, 4)", ("value", "price"))
    assert s.memory == 9 and s.exogenous == ["price"] and s.recursive
