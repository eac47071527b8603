import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from baitwatch.plans.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", memory="4g", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def mails(spark):
    def make(*texts):
        return spark.createDataFrame(list(enumerate(texts)), "mail_id long, email_text string")

    return make


@pytest.fixture(scope="session")
def analyse(mails):
    from baitwatch.operators.detect import analyse_mail

    def run(*texts):
        return analyse_mail(mails(*texts)).orderBy("mail_id").collect()

    return run
