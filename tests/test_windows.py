from turnsift.operators import reports, windows


def burst():
    rows = [(0, "user", "testmessage72, respond okay72")]
    rows += [(1 + i * 0.05, "assistant", f"ok{i}") for i in range(19)]
    return rows + [(3, "assistant", "okay72"), (4, "assistant", "okay71")]


def test_velocity(log, mode):
    flagged = windows.velocity_lab(log(burst())).where("reason is not null").collect()
    assert sorted(r.seq for r in flagged) == list(range(6, 20))
    assert windows.velocity_ext(log(burst())).where("bulk").count() == 0


def test_burst_report(log, mode):
    (row,) = reports.bulk_bursts(log(burst()), least=15).collect()
    assert (row.rows, row.delay_ms) == (19, 1000)


def test_historical_run(log, mode):
    rows = [(i, "assistant", f"text {i}") for i in range(4)] + [(400 + i, "assistant", f"text {i}") for i in range(4)]
    got = {r.seq: (r.filtered, list(r.filtered_by)) for r in windows.signal_pipeline_lab(log(rows)).collect()}
    assert got[4] == (True, ["temporal_historical"])
    assert got[6] == (True, ["temporal_historical", "autocorrelation_pattern"])
    assert got[0] == (False, [])


def test_preserved_command(log, mode):
    rows = [(0, "user", "go")] + [(1 + i * 0.01, "assistant", f"PLAY: song{i}.mp3") for i in range(8)]
    got = {r.seq: (r.filtered, r.preserved_by) for r in windows.signal_pipeline_lab(log(rows)).collect()}
    assert got[8] == (False, "musical_command")
