"""Column contracts, labelling rule and report scope."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

# The source header of every logical column.
SOURCE_COLUMNS = {
    "user_id": "淘宝ID",
    "sub_order_id": "子订单编号",
    "product_name": "选购商品",
    "sample_type": "派样类型",
    "sku": "货号",
    "merchant_code": "商家编码",
    "order_submit_time": "订单提交时间",
    "pay_time": "支付时间",
    "order_status": "订单状态",
    "after_sale_status": "售后状态",
    "payable_amount": "订单应付金额",
    "influencer_name": "达人昵称",
    "category": "品类",
    "channel_type": "渠道",
    "platform_discount": "平台优惠",
    "join_time": "入会时间",
    "crowd_name": "人群名称",
}

# The part of a file name that tells which table the file holds.
FILE_KEYWORDS = {
    "orders": "报表订单",
    "samples": "派样",
    "members": "会员",
    "crowds": "人群",
}

# Order statuses that count as a completed sale.
SUCCESS_STATUSES = ("已完成", "已发货", "待发货")

# The columns each table keeps; everything else in a source file is dropped.
ORDER_COLUMNS = (
    "user_id", "sub_order_id", "sku", "influencer_name", "order_status",
    "after_sale_status", "payable_amount", "pay_time", "order_submit_time",
    "category", "channel_type", "platform_discount",
)
SAMPLE_COLUMNS = (
    "user_id", "sub_order_id", "sample_type", "sku", "product_name",
    "merchant_code", "order_status", "payable_amount", "pay_time",
    "order_submit_time",
)
MEMBER_COLUMNS = ("user_id", "join_time")
CROWD_COLUMNS = ("crowd_name", "user_id")

# Column -> (texts that mean "missing", value that stands for it).
ORDER_TEXT = {
    "sku": (("nan", ""), "unknown"),
    "order_status": (("nan", ""), "unknown"),
    "after_sale_status": (("nan", "", "-", "None"), "none"),
    "influencer_name": (("nan", ""), "shelf"),
    "category": (("nan", ""), "unclassified"),
    "channel_type": (("nan", ""), "unknown"),
    "platform_discount": (("nan", "-", "None"), ""),
}
SAMPLE_TEXT = {
    c: (("nan", "", "None", "-"), "unknown")
    for c in ("sample_type", "sku", "order_status", "product_name", "merchant_code")
}
CROWD_TEXT = {"crowd_name": (("nan", "", "None"), "unnamed")}
ID_TOKENS = ("nan", "", "None")

MONEY = T.DecimalType(18, 2)

NEW = "new"
RETURNING = "returning"


@dataclass(frozen=True)
class LabelRule:
    """When an order counts as placed by a returning customer.

    An order is `returning` if the same user has a qualifying order whose age in
    whole days lies in [min_days, window]. Qualifying: status in `statuses`,
    amount of at least `min_amount` and, if given, one of `channels`.
    """

    min_amount: float = 550
    min_days: int = 1
    window: int = 9999
    channels: tuple[str, ...] = ()
    statuses: tuple[str, ...] = SUCCESS_STATUSES


DateRange = tuple[dt.date, dt.date]


@dataclass(frozen=True)
class Scope:
    """Global report filter. Empty tuples and None mean "no restriction"."""

    dates: DateRange | None = None
    categories: tuple[str, ...] = ()
    channels: tuple[str, ...] = ()
    influencers: tuple[str, ...] = ()
    skus: tuple[str, ...] = ()
    sku_keyword: str = ""
    statuses: tuple[str, ...] = ()
    after_sale: tuple[str, ...] = ()
    min_amount: float = 0.0
    max_amount: float | None = None
    previous_dates: DateRange | None = None

    def year_ago(self) -> "Scope | None":
        """Same filter on the comparison range; one year back unless one is given."""
        if self.previous_dates:
            return replace(self, dates=self.previous_dates, previous_dates=None)
        if not self.dates:
            return None
        return replace(self, dates=tuple(_years_back(d, 1) for d in self.dates))


def _years_back(d: dt.date, n: int) -> dt.date:
    # 29 February has no counterpart in a common year and maps to the 28th.
    try:
        return d.replace(year=d.year - n)
    except ValueError:
        return d.replace(year=d.year - n, day=28)


@dataclass(frozen=True)
class Tables:
    """The tables every report reads. Optional ones may be absent.

    `orders` carries `customer_type` and `purchase_rank`; `pairs` holds two
    consecutive orders of a user per row. `hot_users` lists the users whose share
    of all rows calls for a plan of their own (see operators.skew).
    """

    orders: object
    pairs: object = None
    samples: object = None
    members: object = None
    crowds: object = None
    hot_users: tuple[str, ...] = field(default_factory=tuple)

    def need(self, name: str):
        table = getattr(self, name)
        if table is None:
            raise SourceMissing(name)
        return table


class SourceMissing(LookupError):
    """A report was asked for whose source table was not delivered."""

    def __init__(self, name: str):
        super().__init__(f"no '{name}' table was delivered")
        self.name = name
