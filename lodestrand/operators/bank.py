"""Bank products as column expressions: interest, fees, screening, posting and settlement.

Amounts are whole cents (long), so that every engine rounds alike. Interest rounds half
away from zero; fees are cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rates in millionths, limits and fees in cents.
SAVINGS = ((500_000, 12_500), (None, 20_000))  # up to this balance, this rate
CHECKING_RATE = 1_000
DAY_BASIS, LONGEST = 365, 31
MINIMUM, FLAT, BUSINESS, PER_ITEM, FREE_ITEMS = 150_000, 500, 1_000, 25, 10
LIMITS = {"WEB": 20_000_000, "ATM": 5_000_000, "BRANCH": 50_000_000}
REPORT_AT, OVERDRAFT_FEE = 40_000_000, 2_500


def interest(balance: Column, days: Column, product: Column) -> dict[str, Column]:
    """interest (cents) and flag: 'N' no accrual, 'B' bad product, 'L' long period, else ' '."""
    (low, low_rate), (_, high_rate) = SAVINGS
    rate = F.when(product == "S", F.when(balance <= low, low_rate).otherwise(high_rate)).when(product == "C", CHECKING_RATE)
    top = balance * rate * days
    bottom = 1_000_000 * DAY_BASIS
    rounded = _half_up(top, bottom)
    bad = rate.isNull()
    amount = F.when((balance <= 0) | bad, F.lit(0).cast("long")).otherwise(rounded)
    flag = F.when(balance <= 0, "N").when(bad, "B").when(days > LONGEST, "L").otherwise(" ")
    return {"interest": amount, "flag": flag}


def _half_up(top: Column, bottom: int) -> Column:
    """Whole division of a non-negative number, rounded half up, without floating point."""
    return F.call_function("div", top * 2 + bottom, F.lit(2 * bottom))


def fee(average: Column, items: Column, segment: Column) -> dict[str, Column]:
    """fee (cents) and code: 'W' waived, 'C' charged, 'E' unknown segment."""
    business = F.lit(BUSINESS) + F.greatest(items - FREE_ITEMS, F.lit(0)) * PER_ITEM
    code = F.when(segment == "T", "W").when(segment == "R", F.when(average >= MINIMUM, "W").otherwise("C")).when(segment == "B", "C").otherwise("E")
    return {"fee": F.when((segment == "R") & (average < MINIMUM), F.lit(FLAT)).when(segment == "B", business).otherwise(0).cast("long"), "code": code}


def screen(amount: Column, currency: Column, used: Column, channel: Column) -> dict[str, Column]:
    """decision ('R' review, 'I' invalid, 'D' decline, 'A' accept, in this order) and report ('Y' only if accepted at the threshold)."""
    limit = F.when(F.lit(False), F.lit(0))
    for name, cents in LIMITS.items():
        limit = limit.when(channel == name, cents)
    decision = F.when(currency != "USD", "R").when(amount <= 0, "I").when(used + amount > F.coalesce(limit.otherwise(0), F.lit(0)), "D").otherwise("A")
    return {"decision": decision, "report": F.when((decision == "A") & (amount >= REPORT_AT), "Y").otherwise("N")}


def post(postings: DataFrame, accounts: DataFrame) -> DataFrame:
    """postings (seq, account, type C/D, amount) against the opening balance of accounts (account, balance, overdraft): adds after and reject.

    Every posting sees the opening balance; rejected ones leave it as it is.
    """
    joined = postings.join(accounts, "account", "left")
    after = F.when(F.col("type") == "C", F.col("balance") + F.col("amount")).when(F.col("type") == "D", F.col("balance") - F.col("amount"))
    reject = F.when(F.col("balance").isNull(), "unknown account").when(~F.col("type").isin("C", "D"), "bad type").when((F.col("type") == "D") & (after < -F.col("overdraft")), "over limit")
    charged = F.when((F.col("type") == "D") & (after < 0), after - OVERDRAFT_FEE).otherwise(after)
    return joined.select(*postings.columns, "balance", F.when(reject.isNull(), charged).otherwise(F.col("balance")).alias("after"), reject.alias("reject"))


def settle(accounts: DataFrame, interest_: DataFrame, posted: DataFrame, fees: DataFrame, cumulative: bool = False) -> DataFrame:
    """Closing balances. The last posting of the day wins (its opening balance lacks the day's interest); `cumulative` adds all movements instead."""
    last = posted.filter("balance IS NOT NULL").groupBy("account").agg(F.max_by("after", "seq").alias("posted"), F.sum(F.col("after") - F.col("balance")).alias("moved"))
    rows = accounts.join(interest_, "account", "left").join(last, "account", "left").join(fees, "account", "left")
    opening = F.col("balance") + F.coalesce("interest", F.lit(0))
    base = opening + F.coalesce("moved", F.lit(0)) if cumulative else F.coalesce("posted", opening)
    return rows.select("account", "balance", (base - F.coalesce("fee", F.lit(0))).alias("closing"))
