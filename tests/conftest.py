import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from repeatwise.session import local_session  # noqa: E402

ORDER_DEFAULTS = {
    "sku": "s1", "influencer_name": "i1", "order_status": "done", "after_sale_status": "none",
    "gmv": "100", "category": "c1", "channel_type": "self", "platform_discount": "",
}


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, memory="4g", app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_orders(spark):
    """Cleaned orders from dicts; sub_order_id is the row number unless given."""
    def make(rows):
        full = [{**ORDER_DEFAULTS, "sub_order_id": f"{i:05d}", **r} for i, r in enumerate(rows)]
        names = ["user_id", "sub_order_id", "pay_time", *ORDER_DEFAULTS]
        df = spark.createDataFrame([tuple(str(r[n]) for n in names) for r in full],
                                   ", ".join(f"{n} string" for n in names))
        return df.selectExpr(
            *[n for n in names if n not in ("pay_time", "gmv")],
            "cast(pay_time as timestamp_ntz) as pay_time", "cast(gmv as decimal(18,2)) as gmv",
            "cast(gmv as decimal(18,2)) as payable_amount",
            "cast(pay_time as timestamp_ntz) as order_submit_time",
            "cast(cast(pay_time as timestamp_ntz) as date) as order_date",
            "substring(pay_time, 1, 7) as order_ym")
    return make
