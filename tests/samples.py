"""Small hand-made logs."""

DISPATCHER_LOG = """\
[2/3/2026 9:12:4]
Thread: 3 Cpu usage: 41.5% Idle: 58.25% Other: 0.25% Players online: 12
 Time (ms)     Calls     Rel usage %    Real usage % Description
       640        20       80.50000%       33.40000% tick(queue)

[2/3/2026 9:12:34]
Thread: 3 Cpu usage: 62.75% Idle: 37% Other: 0.25% Players online: 15
 Time (ms)     Calls     Rel usage %    Real usage % Description
       900        45       50.25000%       31.50000% tick(queue)
       400         9       22.50000%       14.12500% flush(pages)
         7        70        0.50000%        0.25000% ping

[2/3/2026 10:1:9]
Thread: 4 Cpu usage: 8% Idle: 91.5% Other: 0.5% Players online: 9
 Time (ms)     Calls     Rel usage %    Real usage % Description
        55         5      100.00000%        2.50000% flush(pages)
"""

LUA_LOG = """\
[2/3/2026 9:12:40]
 Time (ms)     Calls     Rel usage %    Real usage % Description
        88         4       60.00000%        4.40000% jobs/mail.lua:send
        21         2       15.00000%        1.10000% run [[
  for box in boxes do
    box:empty()
]]:chunk

[2/3/2026 9:13:10]
 Time (ms)     Calls     Rel usage %    Real usage % Description
         5         1      100.00000%        0.25000% jobs/mail.lua:send
"""

MULTI_LINE_NAME = "run [[\n  for box in boxes do\n    box:empty()\n]]:chunk"

DISPATCHER_SLOW = """\
[2/3/2026 9:12:11] Execution time: 24 ms - tick(queue) - late
[2/3/2026 9:40:2] Execution time: 130 ms - compact - pages
"""

SPECIAL_SLOW = """\
[3/3/2026 22:5:10] Execution time: 18 ms - closeRoom - attic
[3/3/2026 22:5:12] Execution time: 51 ms - openRoom - attic
[3/3/2026 22:58:0] Execution time: 33 ms - closeRoom - cellar
[3/3/2026 23:0:31] Execution time: 27 ms - closeRoom - porch
"""

FILES = {
    "dispatcher.log": DISPATCHER_LOG,
    "lua.log": LUA_LOG,
    "dispatcher_slow.log": DISPATCHER_SLOW,
    "special_slow.log": SPECIAL_SLOW,
}


def write_logs(folder, files=FILES):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        data = text if isinstance(text, bytes) else text.encode()
        (folder / name).write_bytes(data)
    return str(folder)


def cpu_block(stamp, time_ms=10, calls=1, name="fn"):
    return (
        f"[{stamp}]\n Time (ms)     Calls     Rel usage %    Real usage % Description\n"
        f"{time_ms:10d}{calls:10d}       50.00000%        0.50000% {name}\n\n"
    )


def slow_line(stamp, ms=20, name="task", detail="go"):
    return f"[{stamp}] Execution time: {ms} ms - {name} - {detail}\n"
