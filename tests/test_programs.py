"""The programs over files, through their command lines."""

from tessera.plans import programs


def out(path):
    return [line for p in sorted(path.glob("part-*")) for line in p.read_text().splitlines()]


def test_select(spark, tmp_path):
    (tmp_path / "in.csv").write_text("1,b,2.5\n2,a,0.5\n3,b,1\n4,c,9\n")
    base = [f"{tmp_path}/in.csv", f"{tmp_path}/out", "n:Integer,s:String,f:Float", "f,n"]
    programs.main(["select", *base, "s|>=|b,f|>|1"])
    assert out(tmp_path / "out") == ["2.5,1", "9.0,4"]
    programs.main(["select", *base, "s|>=|b,f|>|1", "--dictionary", "s"])
    assert out(tmp_path / "out") == ["2.5,1", "9.0,4"]
    programs.main(["select", *base, ""])
    assert [x.split(",")[1] for x in out(tmp_path / "out")] == ["1", "2", "3", "4"]


def test_join(spark, tmp_path):
    (tmp_path / "c.tbl").write_text("1|x\n3|y\n3|z\n")
    (tmp_path / "o.tbl").write_text("".join(f"{i}|{k}|2|3|4|5|6|7|comment {i}|\n" for i, k in enumerate([1, 2, 3, 3])))
    programs.main(["join", f"{tmp_path}/c.tbl", f"{tmp_path}/o.tbl", f"{tmp_path}/out"])
    assert sorted(out(tmp_path / "out")) == ["1,comment 0", "3,comment 2", "3,comment 3"]


def test_answers(spark, tmp_path):
    ips = [f"{10 + i % 3}.0.0.{i % 5}" for i in range(400)]
    (tmp_path / "e.tsv").write_text("".join(f"{ip}\trest\n" for ip in ips))
    (tmp_path / "w.txt").write_text("300 10.9.9.9 0\n100 12.0.0.1 50\n")
    programs.main(["windows", f"{tmp_path}/e.tsv", f"{tmp_path}/w.txt", f"{tmp_path}/w", "--window", "200", "--error", "0.05"])
    got = [int(x) for x in out(tmp_path / "w")[0].split(",")]
    exact = [sum(ip.startswith(p) for ip in ips[t - w + 1 : t + 1]) for t, p, w in ((100, "12.", 50), (300, "10.", 200))]
    assert all(abs(a - b) <= 10 for a, b in zip(got, exact, strict=True))
    (tmp_path / "p.txt").write_text("30 10.0.0.0\n\n399 11.0.0.1\n200 9.9.9.9\n")
    want = [sum(ip == a for ip in ips[: t + 1]) for t, a in ((30, "10.0.0.0"), (200, "9.9.9.9"), (399, "11.0.0.1"))]
    programs.main(["points", f"{tmp_path}/e.tsv", f"{tmp_path}/p.txt", f"{tmp_path}/p"])
    assert out(tmp_path / "p") == [",".join(map(str, want))]
    programs.main(["points", f"{tmp_path}/e.tsv", f"{tmp_path}/p.txt", f"{tmp_path}/p", "--sketch"])
    assert all(int(a) >= b for a, b in zip(out(tmp_path / "p")[0].split(","), want, strict=True))
    (tmp_path / "r.txt").write_text("10.0.0.5\t10.255.0.0\n12.0.0.0 12.0.0.0\n1.0.0.0 200.0.0.0\n13.0.0.0 12.0.0.0\n")
    programs.main(["ranges", f"{tmp_path}/e.tsv", f"{tmp_path}/r.txt", f"{tmp_path}/r"])
    assert out(tmp_path / "r") == ["false,true,true,false"]


def test_bloom(spark, tmp_path):
    (tmp_path / "r.tbl").write_text("".join(f"{2 * i}|{3 * i}\n" for i in range(100)))
    (tmp_path / "s.tbl").write_text("".join(f"{3 * i}|{4 * i}\n" for i in range(50, 150)) + "150|7\n-1|7\n")
    programs.main(["bloom", f"{tmp_path}/r.tbl", f"{tmp_path}/s.tbl", f"{tmp_path}/out", "--buckets", "1000"])
    assert sorted(out(tmp_path / "out/rows")) == sorted([f"{2 * i}|{3 * i}|{4 * i}" for i in range(50, 100)] + ["100|150|7"])
    assert out(tmp_path / "out/bytes") == [f"125,{8 * (51 + 50)}"]


def test_schedule(spark, tmp_path):
    (tmp_path / "log.csv").write_text("0,1,1,begin,,\n0,2,1,insert,5,50\n0,3,2,begin,,\n0,4,2,read,5,\n0,5,2,commit,,\n0,6,1,commit,,\n")
    programs.main(["schedule", f"{tmp_path}/log.csv", f"{tmp_path}/out"])
    assert out(tmp_path / "out")[3] == "0,4,2,read,5,ok,50,committed" and len(out(tmp_path / "out")) == 6


def test_skyline(spark, tmp_path):
    (tmp_path / "car.csv").write_text("5|5\n3|9\n9|3\n6|6\n3|9\n")
    programs.main(["skyline", f"{tmp_path}/car.csv", f"{tmp_path}/out", "--block", "2"])
    assert out(tmp_path / "out") == ["3|9", "3|9", "5|5", "9|3"]
