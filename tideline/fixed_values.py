"""Names, cut points, word lists and rule texts.

These must equal the values the analysed alert scheme uses; nothing here is logic.
"""

# Stage names and the measure's cut points, lowest first.
STAGE_NAMES = ["미발령", "관심", "경계", "조류대발생"]
STAGE_CODES = {"미발령": 0, "관심": 1, "경계": 2, "조류대발생": 3}
STAGE_CUTS = [1_000, 10_000, 1_000_000]
TOP_STAGE_WORD = "대발생"

# Season labels by season code (0 winter .. 3 autumn).
SEASON_NAMES = ["겨울", "봄", "여름", "가을"]

# Probability bands.
BAND_CUTS = [0.3, 0.5, 0.7]
BAND_NAMES = ["정상", "주의", "관심 가능성↑", "경계 가능성↑"]

# Column names of the site-by-day panel.
DATE = "조사일"
SITE = "채수위치"
STAGE_LABEL = "발령단계"
STAGE_CODE = "발령단계_코드"
TOTAL = "total_cyano"
SPECIES = ["microcystis", "anabaena", "oscillatoria", "aphanizomenon"]
WATER_TEMP = "수온(℃)"
PH = "pH"
DO = "DO(㎎/L)"
TURBIDITY = "탁도"
CHL_A = "Chl-a (㎎/㎥)"
CLARITY = "투명도"
AIR_TEMP = "평균기온(°C)"
MAX_TEMP = "최고기온(°C)"
RAIN = "일강수량(mm)"
RAIN_DAM = "강우량(mm)"
RAIN_SUM = "일일강수합_mm"
WIND = "평균 풍속(m/s)"
HUMIDITY = "평균 상대습도(%)"
SUNSHINE = "합계 일조시간(hr)"
RADIATION = "합계 일사량(MJ/m2)"
LEVEL = "수위(EL_m)"  # "수위(EL.m)" in the files; headers lose their dots on reading
STORAGE = "저수율(%)"
INFLOW = "유입량(㎥/s)"
OUTFLOW = "총방류량(㎥/s)"
WEEK_RAIN = "일강수_주합_mm"

# Columns the daily flow cannot do without.
REQUIRED = [
    "조사일",
    "채수위치",
    "발령단계",
    "발령단계_코드",
    "target_발령단계_D7_코드",
    "roll7_mean_수온(℃)",
    "채수위치_코드",
]

# Name parts that mark a feature as not exogenous.
ENDOGENOUS = ["total_cyano", "microcystis", "anabaena", "oscillatoria", "aphanizomenon", "발령단계"]

# Lag families of feature names: (pattern, label), first match.
LAG_FAMILIES = [
    ("^lw1_", "직전1주(lw1)"),
    ("^lw2_", "최근2주평균(lw2)"),
    ("^lw4_slope", "4주추세(slope)"),
    ("^lw4_mean", "4주평균"),
]
LAG_FAMILY_OTHER = "기타"

# Year weights of the year-weighted model are given by the caller; 1.0 elsewhere.
CLASS_BOOST = 3.0

# Weekly recommendation rules: id -> title, condition, expectation, actions.
WEEKLY_RULES = {
    "S1": (
        "폭염·고일조·방류 감소",
        "최근 4주 평균 수온 높음, 일조 증가 추세, 방류 감소 추세",
        "정체·광합성 유리 → 남조류 증가 가능성",
        ["관심 단계 사전 대응 검토", "현장 채수·종조성 모니터링 강화", "취수장·정수 약품 투입 계획 점검"],
    ),
    "S2": (
        "집중호우·유입 증가",
        "최근 4주 강수·유입 증가 추세",
        "단기 혼합으로 세포 수 변동 가능, 영양염 유입에 따른 지연 증가 위험",
        ["1~2주 후 재예측·채수 주기 단축", "탁도·유해남조류 동시 추적"],
    ),
    "S3": (
        "방류 감소·수온 높음",
        "방류 감소 추세와 고수온",
        "체류시간 증가로 조류 증식 가능성",
        ["수문·방류 운영 검토", "취수 수심·위치 조정 가능성 검토"],
    ),
    "S4": (
        "Chl-a·pH 상승",
        "클로로필-a 및 pH 상승 추세",
        "조류 생체량 증가 신호, 유해남조류 증가 가능성",
        ["조류 종 분석 강화", "발령단계 전환 모니터링"],
    ),
    "SX": (
        "모델 기반 위험",
        "관심 이상 확률 약 %s%%, 예측 세포수(대략) %s cells/mL",
        "다음 주 관심 이상 가능성 상대적으로 큼",
        ["해당 지점 수질 모니터링 강화", "취수장 사전 대응·활성탄 등 준비", "방류량 조정 가능성 검토"],
    ),
    "S0": ("특이 패턴 없음", "주요 시나리오 조건 미충족", "상시 모니터링 유지", ["정기 관측 유지"]),
}

# Daily rules: id -> actions (the first two are reported).
DAILY_RULE_ACTIONS = {
    "S1_고온건조": ["조류 모니터링 주 2회 이상 강화", "취수구 심층수 전환 검토", "조류제거선 사전 대기"],
    "S2_저수위_체류": ["방류량 증가로 체류시간 단축", "상류 지류 수질 모니터링", "녹조방지 포기장치 가동"],
    "S3_관심단계_진입": ["상수도 조류독소(MC-LR) 검사 실시", "정수처리 PAC 투입량 증가", "민원 선제적 공지 준비"],
    "S4_경계단계_임박": [
        "경계 경보 발령 준비 및 관계기관 사전 통보",
        "취수 중단 시나리오 검토",
        "황토 살포 등 긴급 제거 조치",
        "유역 내 비점오염원 점검 강화",
    ],
    "S5_강우_후_유입": [
        "강우 후 비점오염 유입 모니터링",
        "댐 유입구 탁도/T-N, T-P 측정",
        "향후 7~14일 남조류 급증 위험 주의보 발령",
    ],
}
DAILY_NO_RULE = ("없음", "정상 모니터링 유지")

# Scenario action table: scenario -> (risk level, {horizon: actions}).
SCENARIO_ACTIONS = {
    "S-RED": (
        "최고위험 (경계 23%)",
        {
            "즉시(0-24h)": [
                "취수구 심층 전환 (표층 취수 중단)",
                "조류 경보 발령 절차 개시",
                "하류 정수장 활성탄 처리 준비",
            ],
            "단기(1-3일)": [
                "방류량 단계적 증가 → 체류시간 단축 목표",
                "문의→추동→회남 확산 경로 48h 집중 모니터링",
                "조류제거선 출동 대기",
            ],
            "관찰(지속)": [
                "수온 실측치 확인 (lag 14일 기온 예측 vs 실측 비교)",
                "일사량·풍속 변화 추적 (성층화 안정도)",
            ],
        },
    ),
    "S-ORA": (
        "고위험 (경계 17%)",
        {
            "즉시(0-24h)": [
                "영양염 유입 모니터링 강화 (TN·TP 실시간)",
                "방류 급감소 원인 확인 → 체류시간 증가 방지",
            ],
            "단기(1-3일)": [
                "강우 종료 후 7-14일을 '지연 폭발 감시 기간'으로 설정",
                "유입량·영양염 농도 기반 위험지수 일 1회 산출",
            ],
            "관찰(지속)": [
                "DO 하락 여부 모니터링 (혐기성 조건 형성 전조)",
                "종 구성 변화 주 2회 확인",
            ],
        },
    ),
    "S-YEL": (
        "주의 (경계 16%)",
        {
            "즉시(0-24h)": [
                "조류 측정 빈도 일 1회 → 일 2회 증가",
                "누적 스트레스 지수(CSI) 일별 계산 개시",
            ],
            "단기(1-3일)": [
                "14일 후 수온 예측 (현재 기온 lag 기반)",
                "방류 조절 시나리오 A 준비 (체류시간 관리)",
            ],
            "관찰(지속)": [
                "풍속 2m/s 이하 지속 시 S-ORA 격상 검토",
                "저수율 60% 이하 유지 유도 (수체 유동성 확보)",
            ],
        },
    ),
    "S-GRN": (
        "안전 (경계 4%)",
        {
            "즉시(0-24h)": ["정례 모니터링 유지"],
            "단기(1-3일)": ["기상 예보 기반 시나리오 전환 여부 주 1회 검토"],
            "관찰(지속)": ["방류량 유지 → 체류시간 최소화 기조 유지"],
        },
    ),
}

# Types of missed top-stage alerts.
MISS_TYPES = ["유형B: 극단 강수 이후 OOD", "유형C: 계절 이상 (9월↓)", "유형A: 급격한 환경 변화"]

# Activity tags: tag -> words that imply it.
ACTIVITY_WORDS = {
    "물순환·방류·유입": ["유입", "강수", "호우", "방류", "수문", "혼합", "체류", "저수", "유량"],
    "취수·위치": ["취수", "수심", "위치 조정", "취수장"],
    "제거선·인력": ["제거선", "인력 투입", "인력", "제거 "],
    "약품·활성탄": ["활성탄", "약품", "응집", "PAC", "전처리", "응집제"],
    "모니터링·분석": ["모니터링", "분석", "재예측", "발령", "종 ", "탁도", "클로로필", "pH"],
}
ACTIVITY_NONE = "(키워드 미매칭 — 수동 매핑)"
