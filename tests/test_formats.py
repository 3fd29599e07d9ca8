from lumberline.functions.formats import FORMATS, PLAIN, detect_format, learn_header
from lumberline.functions.masking import mask_line

SAMPLES = {
    "json": '{"time": "2025-03-04T05:06:07Z", "lvl": 40, "msg": "Cart emptied: /basket"}',
    "cef": "CEF:0|Acme|Gate|2.4|77|Door Opened|5|who=guest7 dpt=8443",
    "rfc5424": "<165>1 2025-03-04T05:06:07.089Z edge-9 mailer 4410 id_31 - Queue drained",
    "logcat_brief": "W/AudioSink: Fetching from http://radio.example/stream",
    "os_log": "2025-03-04 05:06:07.654321+0100 0x9f3e1d Error 0x0 777 5 org.tool: Rewinding",
    "oslog_console": "[Disk:Cache] WARNING: Evicting from ColdTier to WarmTier",
    "plain": "2025-03-04 05:06:07 [WARN] [Billing] - Retry scheduled for invoice of guest7",
}
CONTENT = {
    "json": "lvl=<NUM> Cart emptied: /basket",
    "cef": "CEF Acme Gate 77 Door Opened 5 who=guest7 dpt=<NUM>",
    "rfc5424": "RFC5424 <HOST> mailer <NUM> id_<NUM> Queue drained",
    "logcat_brief": "W AudioSink Fetching from <URL>",
    "os_log": "OSLOG Error org.tool: Rewinding",
    "oslog_console": "Disk:Cache WARNING Evicting from ColdTier to WarmTier",
}


def test_each_sample_is_its_own_format(spark):
    for name, line in SAMPLES.items():
        assert detect_format(spark.createDataFrame([(line,)] * 4, "text string")).name == name


def test_contents():
    for f in FORMATS:
        assert f.normalize(SAMPLES[f.name], mask_line)[0] == CONTENT[f.name]
    assert FORMATS[0].normalize('{"ts": 1752000000}', mask_line) == ("<EMPTY>", 1752000000000)
    assert FORMATS[0].normalize("{broken 12", mask_line) == ("{broken <NUM>", None)
    assert PLAIN.normalize("took 5ms", mask_line) == ("took <TIME>", None)


def test_few_hits_are_plain(spark):
    rows = [(SAMPLES["json"],)] + [("text",)] * 9
    assert detect_format(spark.createDataFrame(rows, "text string")) is PLAIN


def test_header_learning():
    ios = [f" MyApp[{12345 + i % 4}:{i}] <{'ERROR' if i % 3 else 'INFO'}> File.swift:{i} message {chr(97 + i % 26)}{i}x" for i in range(60)]
    assert learn_header(ios)[:1] == ("<NUM>",)
    server = [f" INFO worker-{i % 8} request {i} done by someone{chr(97 + i % 26)}" for i in range(60)]
    assert learn_header(server)[:2] == (None, "<NUM>")
    assert learn_header(server[:7]) == ()
    assert learn_header(["plain words only here"] * 20) == ()
