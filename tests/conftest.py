import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from churnlens.session import local_session
    s = local_session(4, 8, app="churnlens-tests")
    yield s
    s.stop()


EVENT_SCHEMA = ("user_id long, event_time timestamp, event_type string, price decimal(18,2), "
                "category_id string, category_code string")


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


@pytest.fixture
def events(spark):
    """Build a canonical event frame from (user, 'YYYY-MM-DD[ HH:MM]', type, price[, cat, code])."""
    from decimal import Decimal

    def make(rows):
        full = []
        for r in rows:
            r = list(r) + [None] * (6 - len(r))
            full.append((r[0], ts(r[1]), r[2], None if r[3] is None else Decimal(str(r[3])), r[4], r[5]))
        return spark.createDataFrame(full, EVENT_SCHEMA)
    return make
