import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from postwatch.session import local_session

    return local_session("8")


@pytest.fixture(scope="session")
def stop_words():
    from postwatch.catalog.base import STOP_WORDS

    return STOP_WORDS


@pytest.fixture
def one(spark):
    """Evaluate a column function on one text."""
    from pyspark.sql import functions as F

    def run(function, value, kind="STRING"):
        return spark.createDataFrame([(value,)], f"v {kind}").select(function(F.col("v")).alias("r")).first()["r"]

    return run


@pytest.fixture
def post():
    """A nested post with given fields in place of the usual ones."""

    def make(id_str="1", text="", hashtags=(), retweeted=False, status=None, location=None, lang="en",
             created_at="Tue Oct 16 03:30:00 +0000 2018", extended=True, user="7"):
        return {
            "id_str": id_str, "created_at": created_at, "favorited": False, "retweeted": retweeted,
            "in_reply_to_screen_name": None,
            "retweeted_status": None if status is None else {"id_str": status},
            "user": {"id_str": user, "name": "N", "screen_name": f"s{user}", "description": "d",
                     "lang": lang, "location": location},
            "extended_tweet": {
                "full_text": text, "entities": {"hashtags": [{"text": h} for h in hashtags]}
            } if extended else None,
        }

    return make


@pytest.fixture
def posts(spark, post):
    from postwatch import schemas

    def make(*records):
        return spark.createDataFrame(list(records), schemas.POST)

    return make
