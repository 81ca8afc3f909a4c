"""Fixed values of the data model and the rules."""

# The measurement channels in bit order.
CHANNELS = (
    "heading pitch roll gx gy gz ax ay az lat lon alt ve vn vu speed sat1 sat2 age "
    "lat_std lon_std alt_std ve_std vn_std vu_std roll_std pitch_std heading_std "
    "course course_std lever_x lever_y lever_z mount_x mount_y mount_z antenna_angle visible1 visible2"
).split()
BITS = {name: 1 << i for i, name in enumerate(CHANNELS)}

# The reasons in bit order with their category.
REASONS = {
    "invalid_navigation": "status",
    "heading_unavailable": "status",
    "course_unavailable": "status",
    "navigation_position_drift": "anomaly",
    "navigation_velocity_outlier": "anomaly",
    "stationary_position": "legacy",
    "position_uncertainty": "legacy",
    "stationary_altitude": "legacy",
    "altitude_uncertainty": "legacy",
    "stationary_velocity": "legacy",
    "stationary_vertical": "legacy",
    "stationary_gyro": "legacy",
    "stationary_accel": "legacy",
    "stationary_attitude": "legacy",
    "speed_unavailable": "unavailable",
}
REASON_BITS = {name: 1 << i for i, name in enumerate(REASONS)}
EXCLUDING = sum(bit for name, bit in REASON_BITS.items() if REASONS[name] in ("anomaly", "unavailable"))

# Fields that an outlier or a drift hides, and those that a status note needs one of.
OUTLIER_FIELDS = "lat lon alt speed ve vn vu course course_std".split()
DRIFT_FIELDS = "lat lon speed".split()
NAVIGATION_FIELDS = "lat lon alt speed ve vn vu course course_std lat_std lon_std alt_std ve_std vn_std vu_std".split()
HEADING_FIELDS = "heading heading_std".split()
COURSE_FIELDS = "course course_std".split()

# Limits.
MOTION_G = 0.01
MAX_SPEED = 130 / 3.6
MAX_VERTICAL = 18 / 3.6
MAX_VELOCITY_STD = 5.0
CONTIGUOUS_MS = 3000
EARTH_M = 6371008.8

# Threshold rules of the present and of the earlier policy.
RULES = {"speed_kmh": 85.0, "accel_ms2": 14.0, "brake_ms2": 15.0, "roll_deg": 20.0, "pitch_deg": 18.0, "shock_g": 0.7, "age_s": 10.0, "position_std_m": 2.0, "gap_s": 3.0}
LEGACY_RULES = {"speed_kmh": 80.0, "accel_ms2": 3.0, "brake_ms2": 3.5, "roll_deg": 15.0, "pitch_deg": 12.0, "shock_g": 0.5}
KINDS = {
    "overspeed": ("speed", ["speed"]),
    "acceleration": ("acceleration", ["speed"]),
    "braking": ("acceleration", ["speed"]),
    "pitch": ("attitude", ["pitch"]),
    "roll": ("attitude", ["roll"]),
    "shock": ("vibration", ["ax", "ay", "az"]),
}
GROUPS = ["speed", "acceleration", "attitude", "vibration"]

# Bits of warnings that are in use, and days before which a leap second was added.
ACTIVE_WARNINGS = [1, 5, 6, 7, 8, 13, 14]
LEAP_DAYS = (
    "1981-07-01 1982-07-01 1983-07-01 1985-07-01 1988-01-01 1990-01-01 1991-01-01 1992-07-01 1993-07-01 "
    "1994-07-01 1996-01-01 1997-07-01 1999-01-01 2006-01-01 2009-01-01 2012-07-01 2015-07-01 2017-01-01"
).split()

# Metrics of a rollup.
METRICS = (
    "speed heading pitch roll gx gy gz ax ay az ve vn vu alt lat_std lon_std alt_std heading_std roll_std pitch_std "
    "age sat1 sat2 ve_std vn_std vu_std course course_std"
).split()

# Labels of codes, as users of the model see them.
NAV_LABELS = {0: "初始化", 1: "卫导模式", 2: "组合导航", 3: "纯惯导"}
FIX_LABELS = {
    0: "无定位", 1: "单点定位 / 定向", 2: "伪距差分 / 定向", 3: "组合推算", 4: "RTK 固定解 / 定向",
    5: "RTK 浮点解 / 定向", 6: "单点定位 / 未定向", 7: "伪距差分 / 未定向", 8: "RTK 固定解 / 未定向", 9: "RTK 浮点解 / 未定向",
}
WARNING_LABELS = {
    0: "GNSS 中断（保留位）", 1: "轮速数据中断", 2: "PPS 中断（保留位）", 3: "陀螺异常（保留位）", 4: "加表异常（保留位）",
    5: "主天线短路", 6: "主天线断路", 7: "副天线短路", 8: "副天线断路", 9: "移动网络（保留位）",
    10: "SIM（保留位）", 11: "CORS（保留位）", 12: "倒车状态", 13: "CPU 降频", 14: "CPU 高温",
}
UNKNOWN_LABEL = "未知"
REASON_LABELS = {
    "invalid_navigation": "导航初始化 / 定位无效（保留显示）",
    "heading_unavailable": "定向未就绪（保留显示）",
    "course_unavailable": "静止或低速航迹角（保留显示）",
    "navigation_position_drift": "显著位置漂移",
    "navigation_velocity_outlier": "导航速度解算失真（速度 / 垂向速度 / 不确定度）",
}
SPEED_LABELS = {
    "non_gpchcx": "非 GPCHCX 报文不进入地速剖面",
    "missing_speed": "GPCHCX.speed 缺失或无效",
    "motion_unknown": "缺少三轴振动值，无法判定运动或静止",
    "velocity_solution_outlier": "明显导航速度解算失真",
    "navigation_drift": "明显导航漂移点已隔离",
}
OTHER_SPEED_LABEL = "地速证据不足"
