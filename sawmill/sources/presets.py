"""Header formats and masks of common log collections."""

# Patterns in Python's dialect.
SHARED_MASKS = [
    r"(?:[\w-]+\.)+(?:com|cn|hk|uk|org|net|gov|nl|at|edu|io|asia)",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}",
    r"(\d+\.){3}\d+",
    r"[+-]?\b\d+(\.\d+)?\b",
    r"\b0[xX][\da-fA-F]+\b",
    r"\b(Mon|Tue|Wed|Thu|Fri|Sat|Sun)\b",
    r"\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\b",
    r"root",
]

#: What a text must hold so that a shared mask can match: one of these, so many times. Elsewhere its pattern isn't tried.
NEEDED: dict[str, tuple[tuple[str, ...], int]] = {
    SHARED_MASKS[0]: ((".",), 1),
    SHARED_MASKS[1]: (("-",), 4),
    SHARED_MASKS[2]: ((":",), 7),
    SHARED_MASKS[3]: ((".",), 3),
    SHARED_MASKS[5]: (("0x", "0X"), 1),
    SHARED_MASKS[6]: (tuple("Mon Tue Wed Thu Fri Sat Sun".split()), 1),
    SHARED_MASKS[7]: (tuple("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()), 1),
    SHARED_MASKS[8]: (("root",), 1),
}

# Name, header format, masks.
COLLECTIONS = {
    "HDFS": ("<Date> <Time> <Pid> <Level> <Component>: <Content>", [r"blk_-?\d+", r"(\d+\.){3}\d+(:\d+)?"]),
    "Hadoop": (r"<Date> <Time> <Level> \[<Process>\] <Component>: <Content>", [r"(\d+\.){3}\d+"]),
    "Spark": ("<Date> <Time> <Level> <Component>: <Content>", [r"(\d+\.){3}\d+", r"\b[KGTM]?B\b", r"([\w-]+\.){2,}[\w-]+"]),
    "Zookeeper": (r"<Date> <Time> - <Level>  \[<Node>:<Component>@<Id>\] - <Content>", [r"(/|)(\d+\.){3}\d+(:\d+)?"]),
    "BGL": ("<Label> <Timestamp> <Date> <Node> <Time> <NodeRepeat> <Type> <Component> <Level> <Content>", [r"core\.\d+"]),
    "HPC": ("<LogId> <Node> <Component> <State> <Time> <Flag> <Content>", []),
    "Thunderbird": (r"<Label> <Timestamp> <Date> <User> <Month> <Day> <Time> <Location> <Component>(\[<PID>\])?: <Content>", [r"(\d+\.){3}\d+"]),
    "Windows": ("<Date> <Time>, <Level>                  <Component>    <Content>", [r"0x.*?\s"]),
    "Linux": (r"<Month> <Date> <Time> <Level> <Component>(\[<PID>\])?: <Content>", [r"(\d+\.){3}\d+", r"\d{2}:\d{2}:\d{2}"]),
    "Android": ("<Date> <Time>  <Pid>  <Tid> <Level> <Component>: <Content>", [r"(/[\w-]+)+", r"([\w-]+\.){2,}[\w-]+", r"([-+]?\b\d+\b)|\b0[Xx][a-fA-F\d]+\b|\b[a-fA-F\d]{4,}\b"]),
    "HealthApp": (r"<Time>\|<Component>\|<Pid>\|<Content>", []),
    "Apache": (r"\[<Time>\] \[<Level>\] <Content>", [r"(\d+\.){3}\d+"]),
    "Proxifier": (r"\[<Time>\] <Program> - <Content>", [r"<\d+\ssec", r"([\w-]+\.)+[\w-]+(:\d+)?", r"\d{2}:\d{2}(:\d{2})*", r"[KGTM]B"]),
    "OpenSSH": (r"<Date> <Day> <Time> <Component> sshd\[<Pid>\]: <Content>", [r"(\d+\.){3}\d+", r"([\w-]+\.){2,}[\w-]+"]),
    "OpenStack": (r"<Logrecord> <Date> <Time> <Pid> <Level> <Component> \[<ADDR>\] <Content>", [r"((\d+\.){3}\d+,?)+"]),
    "Mac": (r"<Month>  <Date> <Time> <User> <Component>\[<PID>\]( \(<Address>\))?: <Content>", [r"([\w-]+\.){2,}[\w-]+"]),
}
