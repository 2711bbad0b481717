import time

import pytest

from tessera.plans import jobs
from tessera.plans.jobs import Busy, Jobs


def test_one_job_at_a_time_across_drivers(spark, tmp_path, monkeypatch):
    """Two Jobs objects stand for two drivers: one sees the other's job, is refused, and takes over when its lease is over."""
    monkeypatch.setattr(jobs, "LEASE", 6.0)
    one, two = Jobs(spark, str(tmp_path)), Jobs(spark, str(tmp_path))
    first = one.claim()
    over = one.renewing(first)
    assert two.status(first)["status"] == "running"
    for _ in range(3):  # longer than the lease, which is renewed
        time.sleep(2.5)
        with pytest.raises(Busy):
            two.claim()
    one.end(first, status="completed", result={"n": 1})
    over.set()
    assert two.status(first)["status"] == "completed" and two.status(first)["result"] == {"n": 1}

    second = one.claim()  # its driver dies: nobody renews
    with pytest.raises(Busy):
        two.claim()
    time.sleep(6.5)
    assert two.status(second)["status"] == "lost"
    third = two.claim()
    assert one.status(second)["status"] == "lost" and one.status(third)["status"] == "running"
    one.end(second, status="completed")  # it comes back: the lease stays with the one that took over
    with pytest.raises(Busy):
        one.claim()
    two.end(third, status="failed", error="x")
    assert one.status(third)["error"] == "x" and one.claim()
    with pytest.raises(KeyError):
        one.status("none")


def test_a_status_is_never_torn(spark, tmp_path):
    """While a job beats and its record changes, a reader sees it running, and then ended."""
    import threading

    one, two = Jobs(spark, str(tmp_path)), Jobs(spark, str(tmp_path))
    job = one.claim()
    lease = one.status(job)["lease"]
    worker = threading.Thread(target=lambda: [one._beat(lease) for _ in range(40)] + [one.end(job, status="completed")])
    worker.start()
    seen = []
    while worker.is_alive():
        seen.append(two.status(job)["status"])
    worker.join()
    assert set(seen) <= {"running", "completed"} and two.status(job)["status"] == "completed"
