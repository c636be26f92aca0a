"""Small flow files: values depend on row position only."""

from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.parquet as pq

START = datetime(2026, 1, 5, tzinfo=timezone.utc)
COLUMNS = ["src_id_addr", "dist_id_addr", "dist_port", "ip_protocol_id", "num_bytes", "num_packets", "flow_start_time", "flow_end_time"]


def regular(day: int):
    """Eight hosts, each hour a few flows."""
    for h in range(1, 9):
        for hour in range(24):
            for i in range(2 + (7 * h + 3 * hour + day) % 6):
                k = h * 31 + hour * 7 + i * 13 + day
                t = START + timedelta(days=day, hours=hour, minutes=(k * 7) % 60, seconds=i)
                yield (f"10.0.0.{h}", f"10.0.1.{1 + k % 5}", (443, 80, 53, 22)[k % 4], 17 if k % 4 == 2 else 6, 300 + k * 97 % 5000, 3 + k % 20, t, t + timedelta(seconds=k % 30))


def sweep(day: int, hour: int, host: str):
    """200 ports of one destination, 10 s apart."""
    for i in range(200):
        t = START + timedelta(days=day, hours=hour, seconds=10 * i)
        yield (host, "10.0.2.50", 1000 + i, 6, 60, 1, t, t)


def write(path, rows, **changes):
    rows = list(rows)
    data = {c: [r[i] for r in rows] for i, c in enumerate(COLUMNS)}
    table = pa.table({c: pa.array(v, pa.timestamp("us", "UTC") if c.endswith("_time") else None) for c, v in data.items()})
    for name, column in changes.items():
        table = table.append_column(name, column)
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(table, path)
    return table
