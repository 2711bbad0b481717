"""Indexing jobs that outlive their driver: records and leases beside the index, in files that are written once.

A job's record is its newest version.  Leases are numbered; the holder of the highest is the job that
may run, and a lease is made by a rename that doesn't replace, so one of two claims wins.  A running job
leaves a beat from time to time; after ``LEASE`` seconds without one it counts as lost, and another may
claim the next lease (clocks must agree to within the lease).  No file is ever replaced, so a reader meets
none half-way.  Leases keep two drivers from doing the same work; that no change is lost doesn't rest on
them, but on the manifest, which only one of two runs can commit.
"""

from __future__ import annotations

import json
import threading
import time
import uuid

from pyspark.sql import SparkSession

#: Seconds for which a lease holds after a beat.
LEASE = 30.0


class Busy(RuntimeError):
    """Another job is indexing."""


class Jobs:
    """The jobs of the index below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/_jobs"

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs, fs.makeQualified(at)

    def _names(self, start: str) -> list[str]:
        """Files whose names begin so, in order."""
        fs, at = self._at("x")
        if not fs.exists(at.getParent()):
            return []
        return sorted(n for f in fs.listStatus(at.getParent()) if (n := f.getPath().getName()).startswith(start))

    def _put(self, name: str, value: dict) -> bool:
        """Writes a file whole, by a rename, if there is none of that name; tells whether it did."""
        fs, at = self._at(name)
        fs.mkdirs(at.getParent())
        _, fresh = self._at(f"_new.{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        jvm = self.spark._jvm
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fresh, at, never)
        except Exception:
            fs.delete(fresh, False)
            if not fs.exists(at):
                raise
            return False
        return True

    def _read(self, name: str) -> dict:
        fs, at = self._at(name)
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _delete(self, names: list[str]) -> None:
        for name in names:
            fs, at = self._at(name)
            fs.delete(at, False)

    def _record(self, job: str, value: dict) -> None:
        """A new version of the job's record."""
        while not self._put(f"job-{job}-{len(self._names(f'job-{job}-')):04d}.json", value):
            pass

    def _beat(self, lease: int) -> None:
        before = self._names(f"beat-{lease:09d}-")
        self._put(f"beat-{lease:09d}-{int(time.time() * 1000):015d}", {})
        self._delete(before)

    def _alive(self, lease: int) -> bool:
        beats = self._names(f"beat-{lease:09d}-")
        return bool(beats) and time.time() - int(beats[-1].split("-")[2]) / 1000 <= LEASE

    def status(self, job: str) -> dict:
        """The job's record; a running job that gives no sign, or whose lease another has followed, is lost."""
        versions = self._names(f"job-{job}-")
        if not versions:
            raise KeyError(f"unknown job {job}")
        found = self._read(versions[-1])
        if found["status"] == "running" and (self._names("lease-")[-1] != f"lease-{found['lease']:09d}.json" or not self._alive(found["lease"])):
            last = self._read(self._names(f"job-{job}-")[-1])  # it may just have ended
            return last if last["status"] != "running" else last | {"status": "lost"}
        return found

    def claim(self) -> str:
        """A new running job that holds the highest lease; :class:`Busy` while another's job runs."""
        leases, job = self._names("lease-"), uuid.uuid4().hex
        n = int(leases[-1][6:15]) if leases else 0
        if n:
            held = self._read(leases[-1])["job"]
            if not self._names(f"job-{held}-"):
                if self._alive(n):
                    raise Busy(f"job {held} begins")
            elif (was := self.status(held))["status"] == "running":
                raise Busy(f"job {held} is indexing")
            elif was["status"] == "lost":
                self._record(held, was)
        self._beat(n + 1)
        if not self._put(f"lease-{n + 1:09d}.json", {"job": job}):
            raise Busy("another job was faster")
        self._record(job, {"status": "running", "started": time.time(), "lease": n + 1})
        self._delete([*leases, *self._names(f"beat-{n:09d}-")])
        return job

    def renewing(self, job: str) -> threading.Event:
        """Leaves the job's beats until the event that it returns is set, or another lease follows."""
        over, lease = threading.Event(), self.status(job)["lease"]

        def renew() -> None:
            while not over.wait(LEASE / 3) and self._names("lease-")[-1] == f"lease-{lease:09d}.json":
                self._beat(lease)

        threading.Thread(target=renew, name=f"lease-{job[:8]}", daemon=True).start()
        return over

    def end(self, job: str, **record) -> None:
        """Writes what became of the job."""
        self._record(job, self._read(self._names(f"job-{job}-")[-1]) | record)
