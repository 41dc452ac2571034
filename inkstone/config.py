"""Settings, read once and checked, and the domain pack: lexicons and limits as data."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Limits of chunking, tiers and requests. Values out of bounds are refused when the settings are made."""

    chunk_max_chars: int = 200
    chunk_overlap_chars: int = 50
    chunk_min_chars: int = 40
    min_similarity: float = 0.25
    clear_similarity: float = 0.45
    query_max_chars: int = 500
    max_k: int = 100
    default_k: int = 5
    query_cache: int = 256

    def __post_init__(self) -> None:
        if not 0 < self.chunk_min_chars <= self.chunk_max_chars or not 0 <= self.chunk_overlap_chars < self.chunk_max_chars:
            raise ValueError("chunk limits: 0 < min <= max and 0 <= overlap < max")
        if not 0 <= self.min_similarity <= self.clear_similarity <= 1:
            raise ValueError("similarity limits: 0 <= min <= clear <= 1")
        if not 1 <= self.default_k <= self.max_k or self.query_max_chars < 1 or not 0 <= self.query_cache <= 4096:
            raise ValueError("request limits")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "INKSTONE_") -> Settings:
        """Settings with each field overridden by its upper-case variable, where set."""
        env = os.environ if env is None else env
        given = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw not in (None, ""):
                try:
                    given[f.name] = type(f.default)(raw)
                except ValueError:
                    raise ValueError(f"{prefix}{f.name.upper()}={raw!r} is not a {type(f.default).__name__}") from None
        return cls(**given)


def read_env_file(path: str | Path | None, env: Mapping[str, str] | None = None) -> dict[str, str]:
    """``KEY=value`` lines (``export`` and quotes allowed, ``#`` comments) under what the environment already sets.

    An empty path or a missing file gives just the environment.
    """
    out: dict[str, str] = {}
    if path and Path(path).is_file():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, eq, value = line.strip().removeprefix("export ").partition("=")
            if eq and name.strip() and not name.lstrip().startswith("#"):
                value = value.strip()
                if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
                    value = value[1:-1]
                out[name.strip()] = value
    return out | dict(os.environ if env is None else env)


@dataclass(frozen=True)
class DomainPack:
    """What a language and domain bring along: stop tokens, aliases with the particles that may follow, labels."""

    stop_tokens: tuple[str, ...] = ()
    aliases: Mapping[str, str] = field(default_factory=dict)
    particles: tuple[str, ...] = ()
    #: (alias pair, particles that change after the second): neighbouring names of one law count once.
    synonyms: tuple[str, str] | None = None
    agreement: Mapping[str, str] = field(default_factory=dict)


# Fixed values of the Korean legislation pack.
KOREAN = DomainPack(
    stop_tokens=("관한", "위한", "대한", "통한", "따른", "등에", "등의", "및", "또는", "그리고", "관련", "주요", "내용", "제안이유", "일부개정법률안", "전부개정법률안", "제정법률안", "법률안"),
    aliases={
        "중처법": "중대재해 처벌 등에 관한 법률",
        "중대재해처벌법": "중대재해 처벌 등에 관한 법률",
        "산안법": "산업안전보건법",
        "산재법": "산업재해보상보험법",
        "근기법": "근로기준법",
        "노조법": "노동조합 및 노동관계조정법",
        "전상법": "전자상거래 등에서의 소비자보호에 관한 법률",
        "하도급법": "하도급거래 공정화에 관한 법률",
        "가맹사업법": "가맹사업거래의 공정화에 관한 법률",
        "대부업법": "대부업 등의 등록 및 금융이용자 보호에 관한 법률",
        "공정거래법": "독점규제 및 공정거래에 관한 법률",
        "상증법": "상속세 및 증여세법",
        "자본시장법": "자본시장과 금융투자업에 관한 법률",
        "주임법": "주택임대차보호법",
        "전세사기특별법": "전세사기피해자 지원 및 주거안정에 관한 특별법",
        "개보법": "개인정보 보호법",
        "정통망법": "정보통신망 이용촉진 및 정보보호 등에 관한 법률",
        "플랫폼법": "온라인 플랫폼 중개거래의 공정화에 관한 법률",
        "AI 기본법": "인공지능 발전과 신뢰 기반 조성 등에 관한 기본법",
        "인공지능 기본법": "인공지능 발전과 신뢰 기반 조성 등에 관한 기본법",
        "청탁금지법": "부정청탁 및 금품등 수수의 금지에 관한 법률",
        "양육비이행법": "양육비 이행확보 및 지원에 관한 법률",
        "예보법": "예금자보호법",
        "KIC": "한국투자공사법",
        "ODA": "국제개발협력기본법",
        "개발원조": "국제개발협력기본법",
        "보이스피싱": "전기통신금융사기",
        "요양원": "노인장기요양",
        "집시법": "집회 및 시위에 관한 법률",
        "공선법": "공직선거법",
        "정자법": "정치자금법",
        "헌재법": "헌법재판소법",
        "행심법": "행정심판법",
        "행소법": "행정소송법",
        "국배법": "국가배상법",
        "국보법": "국가보안법",
        "민집법": "민사집행법",
        "형소법": "형사소송법",
        "정보공개법": "공공기관의 정보공개에 관한 법률",
        "공운법": "공공기관의 운영에 관한 법률",
        "이해충돌방지법": "공직자의 이해충돌 방지법",
        "김영란법": "부정청탁 및 금품등 수수의 금지에 관한 법률",
        "특가법": "특정범죄 가중처벌 등에 관한 법률",
        "특경법": "특정경제범죄 가중처벌 등에 관한 법률",
        "성폭력처벌법": "성폭력범죄의 처벌 등에 관한 특례법",
        "아청법": "아동·청소년의 성보호에 관한 법률",
        "성매매처벌법": "성매매알선 등 행위의 처벌에 관한 법률",
        "통비법": "통신비밀보호법",
        "청보법": "청소년 보호법",
        "도교법": "도로교통법",
        "교특법": "교통사고처리 특례법",
        "자배법": "자동차손해배상 보장법",
        "상임법": "상가건물 임대차보호법",
        "상가임대차법": "상가건물 임대차보호법",
        "도정법": "도시 및 주거환경정비법",
        "국토계획법": "국토의 계획 및 이용에 관한 법률",
        "산집법": "산업집적활성화 및 공장설립에 관한 법률",
        "기간제법": "기간제 및 단시간근로자 보호 등에 관한 법률",
        "파견법": "파견근로자 보호 등에 관한 법률",
        "근퇴법": "근로자퇴직급여 보장법",
        "고보법": "고용보험법",
        "건보법": "국민건강보험법",
        "장차법": "장애인차별금지 및 권리구제 등에 관한 법률",
        "조특법": "조세특례제한법",
        "부가세법": "부가가치세법",
        "종부세법": "종합부동산세법",
        "전금법": "전자금융거래법",
        "금소법": "금융소비자 보호에 관한 법률",
        "특금법": "특정 금융거래정보의 보고 및 이용 등에 관한 법률",
        "외감법": "주식회사 등의 외부감사에 관한 법률",
        "표시광고법": "표시·광고의 공정화에 관한 법률",
        "화관법": "화학물질관리법",
        "화평법": "화학물질의 등록 및 평가 등에 관한 법률",
        "자원재활용법": "자원의 절약과 재활용촉진에 관한 법률",
        "탄소중립기본법": "기후위기 대응을 위한 탄소중립ㆍ녹색성장 기본법",
    },
    particles=("에서", "으로", "보다", "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도", "만", "상", "로"),
    synonyms=("ODA", "개발원조"),
    agreement={"는": "은", "가": "이", "를": "을", "와": "과", "로": "으로"},
)
