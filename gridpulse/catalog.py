"""Fixed facts about the monitored transformer: signals, plausibility ranges, rules, nominal values."""

from __future__ import annotations

import math
from dataclasses import dataclass

INF = math.inf

# Panel signals and the historian alias each one comes from.
SIGNAL_ALIASES = {
    "temperatura_aceite": "temp_oil_value",
    "temperatura_aceite_OLTC": "temp_oil_oltc_value",
    "temperatura_ambiente": "temp_ambient_value",
    "temperatura_burbujeo": "temp_bubbling_value",
    "temperatura_punto_caliente": "temp_spot_hot_value",
    "voltaje": "voltage_value",
    "corriente_carga": "current_load_value",
    "potencia_aparente": "power_apparent_value",
    "tap_position": "tap_position_value",
}
SIGNALS = list(SIGNAL_ALIASES.values())
THERMAL = [
    "temp_oil_value",
    "temp_oil_oltc_value",
    "temp_ambient_value",
    "temp_bubbling_value",
    "temp_spot_hot_value",
]
ELECTRICAL = ["voltage_value", "current_load_value", "power_apparent_value"]
MECHANICAL = ["tap_position_value"]

# Token replacements applied to other column names, in this order.
NAME_TOKENS = {
    "temperatura": "temp",
    "corriente": "current",
    "voltaje": "voltage",
    "potencia": "power",
    "aparente": "apparent",
    "aceite": "oil",
    "ambiente": "ambient",
    "caliente": "hot",
    "punto": "spot",
    "burbujeo": "bubbling",
    "posicion": "position",
    "carga": "load",
}
ACCENTED, PLAIN = "áéíóúñ", "aeioun"
DEFAULT_NAME = "var_transformador"

# Inclusive plausibility range by name fragment; the first fragment found applies.
PLAUSIBLE = {
    "temp": (-50, 200),
    "oil": (0, 150),
    "hot": (0, 180),
    "ambient": (-40, 60),
    "current": (0, 5000),
    "voltage": (0, 50000),
    "power": (0, 100000),
    "position": (0, 20),
    "tap": (0, 20),
}

# Name fragments of each technical category.
CATEGORIES = {
    "Térmica": ["temp", "oil", "hot", "ambient", "bubbling"],
    "Eléctrica": ["current", "voltage", "power", "apparent"],
    "Mecánica": ["position", "tap"],
}
OTHER_CATEGORY = "Otras"
# The quality report counts thermal variables without the bubbling fragment.
REPORT_CATEGORIES = {
    "Térmica": ["temp", "oil", "hot", "ambient"],
    "Eléctrica": ["current", "voltage", "power", "apparent"],
    "Mecánica": ["position", "tap"],
}

# Operating range per variable used by the validation step (inclusive).
OPERATING = {
    "temp_oil_value": (0, 120),
    "temp_spot_hot_value": (0, 150),
    "temp_ambient_value": (-40, 60),
    "current_load_value": (0, 5000),
    "power_apparent_value": (0, 200),
    "voltage_value": (100, 150),
    "tap_position_value": (0, 20),
}


@dataclass(frozen=True)
class Rule:
    """Half-open bands [min, max) of one variable."""

    variable: str
    normal: tuple
    alert: tuple
    critical: tuple
    description: str


# Technical criteria, in the order they are applied.
RULES = [
    Rule("temp_oil_value", (35.8, 65.3), (65.3, 75.0), (75.0, INF), "Temperatura del aceite dieléctrico"),
    Rule("temp_spot_hot_value", (38.7, 76.2), (76.2, 100.0), (100.0, INF), "Temperatura del punto caliente (hot-spot)"),
    Rule("temp_ambient_value", (-10.0, 40.0), (40.0, 50.0), (50.0, INF), "Temperatura ambiente (criterio estacional)"),
    Rule("current_load_value", (0.0, 1508.1), (1508.1, 1809.7), (1809.7, INF), "Corriente de carga (A) en lado BT"),
    Rule("factor_carga", (0.0, 1.0), (1.0, 1.2), (1.2, INF), "Factor de carga (p.u.)"),
    Rule("tap_position_value", (6.0, 12.0), (3.0, 15.0), (0.0, 17.0), "Posición del tap OLTC (0–17)"),
]
# Combined criteria (name, variables, condition, severity, description).
COMBINED_RULES = [
    ("sobrecarga_termica", "current_load_value, temp_oil_value", "ambas en alerta o crítico", "critico",
     "Sobrecarga con calentamiento excesivo"),
    ("estres_termico", "temp_spot_hot_value, temp_oil_value", "diferencia >25°C", "alerta",
     "Gradiente térmico excesivo"),
    ("regulacion_inestable", "tap_position_value", "cambios frecuentes", "alerta",
     "Regulación de voltaje inestable"),
]
# State names, texts and limits of the combined criteria.
NORMAL, ALERT, CRITICAL = "NORMAL", "ALERTA", "CRITICO"
OVERLOAD_TEXT = "SOBRECARGA TÉRMICA COMBINADA"
GRADIENT_TEXT = "GRADIENTE TÉRMICO EXCESIVO"
OVERLOAD_CURRENT, OVERLOAD_OIL, GRADIENT_LIMIT = 2000, 70, 25

STATE_COLUMNS = ["estado_operacional", "nivel_severidad", "variables_anomalas", "descripcion_anomalia"]
LABEL_COLUMNS = [
    "falla_30d",
    "estado_futuro",
    "rul_dias",
    "severidad_futura",
    "dias_proximo_evento",
    "proximidad_evento",
    "riesgo_acumulativo",
]
# Labels and states look ahead or are text, so no model may see them.
LEAK_COLUMNS = LABEL_COLUMNS + STATE_COLUMNS


@dataclass(frozen=True)
class Params:
    """Nominal data, windows and policies; override per fleet where needed."""

    horizon_days: int = 30
    rolling_windows: tuple = (24, 72, 168, 720)
    lags: tuple = (1, 6, 12, 24, 48, 72, 168, 336, 720)
    nominal_mva: float = 100.0
    nominal_kv: float = 138.0
    nominal_oil: float = 65.0
    nominal_ambient: float = 40.0
    nominal_hot: float = 100.0
    gradient_limit: float = 25.0
    overload_limit: float = 1.2
    tap_change_limit: float = 5.0
    tap_center: float = 8.5
    power_factor: float = 0.9
    eps: float = 1e-6
    # labels
    critical_days: float = 7.0
    alert_days: float = 15.0
    proximity_days: float = 10.0
    # modelling
    split_ratio: float = 0.8
    lookback: int = 24
    horizon_shift: int = 12
    max_null_ratio: float = 0.30
    alpha: float = 0.9
    beta: float = 1.0
    precision_target: float = 0.60
    smooth_k: int = 4
    smooth_m: int = 7
    trees: int = 400
    seed: int = 42

    @property
    def horizon_hours(self) -> int:
        return self.horizon_days * 24


DEFAULT_PARAMS = Params()

# History window of a first load.
HISTORY_START, HISTORY_END = "2024-09-10T00:00:00Z", "2025-08-28T00:00:00Z"

# Historian alias = point name below the asset prefix.
TAG_POINTS = {
    "temperatura_aceite": "Top oil temperature",
    "temperatura_ambiente": "Ambient temperature",
    "temperatura_punto_caliente": "Hot spot temperature",
    "temperatura_burbujeo": "Bubbling temperature",
    "temperatura_aceite_OLTC": "Oil temperature OLTC 1",
    "tap_position": "Tap position",
    "corriente_carga": "Load current LV Ph 2",
    "voltaje": "Voltage (phase - ground) HV Ph 2",
    "potencia_aparente": "Power (apparent power) 1m",
    "margen_burbujeante": "Bubbling safety margin",
    "buchholz_desconectado": "Buchholz Relay RB disconnected",
    "cambio_capacitancia": "Change of capacitance detected",
    "verificar_conexion_sensor_gas": "Check connection to the gas sensor",
    "verificar_conexion_profibus": "Check Profibus connection",
    "nivel_aceite_tanque_principal_max": "Oil level main tank max",
    "nivel_aceite_tanque_principal_min": "Oil level main tank min",
    "monitores_falla_fuente_alimentacion": "Power supply failure monitors",
    "falla_fuente_alimentacion_vdc": "Power supply failure Vdc",
    "cambio_capacitancia_fase_1": "Change of cap detection HV Ph 1",
    "cambio_capacitancia_fase_2": "Change of cap detection HV Ph 2",
    "cambio_capacitancia_fase_3": "Change of cap detection HV Ph 3",
    "cambio_tan_fase_1": "Change of tan HV Ph 1",
    "cambio_tan_fase_2": "Change of tan HV Ph 2",
    "cambio_tan_fase_3": "Change of tan HV Ph 3",
    "factor_carga_fase_2": "Load factor",
    "max_sobrecarga_fase_2": "Maximum overload",
    "min_sobrecarga_fase_2": "Minimum overload",
    "numero_sobrecargas_fase_2": "Number of overcurrents",
    "numero_sobretensiones_fase_2": "Number of overvoltages",
    "voltaje_fase_1": "Voltage (phase - ground) HV Ph 1",
    "voltaje_fase_3": "Voltage (phase - ground) HV Ph 3",
    "voltaje_fase_1_fase_2": "Voltage (phase - phase) HV Ph 1 - Ph 2",
    "voltaje_fase_2_fase_3": "Voltage (phase - phase) HV Ph 2 - Ph 3",
    "voltaje_fase_3_fase_1": "Voltage (phase - phase) HV Ph 3 - Ph 1",
    "emergencia_enfriamiento_fallido": "Emergency loading cooler failed",
    "emergencia_enfriamiento_sobre_carga": "Emergency loading if overloading",
    "ruptura_membrana_relay": "Membrane rupture relay",
    "flujo_aceite_relay_OLTC": "Oil flow relay OLTC",
    "valvula_alivio_presion": "Pressure relief valve",
    "valvula_alivio_presion_OLTC": "Pressure relief valve OLTC",
    "motor_cortacircuito_OLTC_ON": "Circuit breaker motor OLTC ON",
    "motor_OLTC_en_operacion": "OLTC motor in operation",
    "switch_S21_local": "Switch S21 local",
    "switch_S22_remote": "Switch S22 remote",
    "system_condition": "System condition",
    "acetileno": "Acetylene (C2H2)",
    "dioxido_carbono": "Carbon Dioxide (CO2)",
    "monoxido_carbono": "Carbon Monoxide (CO)",
    "etano": "Ethane (C2H6)",
    "etileno": "Ethylene (C2H4)",
    "hidrogeno": "Hydrogen (H2)",
    "metano": "Methane (CH4)",
    "nitrogeno": "Nitrogen (N2)",
    "oxigeno": "Oxygene (O2)",
    "gradient_acetileno": "Gradient Acetylene (C2H2)",
    "gradient_dioxido_carbono": "Gradient Carbon Dioxide (CO2)",
    "gradient_monoxido_carbono": "Gradient Carbon Monoxide (CO)",
    "gradient_etano": "Gradient Ethane (C2H6)",
    "gradient_etileno": "Gradient Ethylene (C2H4)",
    "gradient_hidrogeno": "Gradient Hydrogen (H2)",
    "gradient_metano": "Gradient Methane (CH4)",
    "gradient_nitrogeno": "Gradient Nitrogen (N2)",
    "gradient_oxigeno": "Gradient Oxygene (O2)",
    "gradient_tdcg": "Gradient TDCG",
    "tdcg": "TDCG",
    "breakdown_voltage": "Breakdown voltage",
    "humedad_papel_aislante": "Moisture of insulation paper",
    "nivel_aceite_OLTC_max": "Oil level OLTC max",
    "nivel_aceite_OLTC_min": "Oil level OLTC min",
    "actividad_agua": "Water activity",
    "contenido_agua_aceite_OLTC_1": "Water content in oil OLTC 1",
    "contenido_agua_aceite_OLTC_2": "Water content in oil OLTC 2",
    "perdidas_actuales": "Actual losses",
    "consumo_vida_util_absoluto": "Lifetime consumption (absolute)",
    "consumo_vida_util_ultimo_anio": "Lifetime consumption during last year",
    "tasa_envejecimiento": "Rate of ageing",
    "tasa_envejecimiento_30d": "Rate of ageing (30d)",
    "resistencia_termica": "Thermal resistance",
    "ventilador_1": "Fan 1",
    "ventilador_1_mcb": "Fan 1 MCB",
    "ventilador_2": "Fan 2",
    "ventilador_2_mcb": "Fan 2 MCB",
    "ventilador_3_mcb": "Fan 3 MCB",
    "ventilador_4_mcb": "Fan 4 MCB",
    "ventilador_5_mcb": "Fan 5 MCB",
    "ventilador_6_mcb": "Fan 6 MCB",
    "ventilador_7_mcb": "Fan 7 MCB",
    "ventilador_8_mcb": "Fan 8 MCB",
    "ventilador_9_mcb": "Fan 9 MCB",
    "ventilador_10_mcb": "Fan 10 MCB",
    "ventilador_11_mcb": "Fan 11 MCB",
    "ventilador_12_mcb": "Fan 12 MCB",
    "ventilador_13_mcb": "Fan 13 MCB",
    "ventilador_14_mcb": "Fan 14 MCB",
}


def category_of(name: str, categories: dict = CATEGORIES) -> list[str]:
    """Every category whose fragments occur in the name; the catch-all when none does."""
    hits = [c for c, parts in categories.items() if any(p in name.lower() for p in parts)]
    return hits or [OTHER_CATEGORY]


def plausible_range(name: str):
    return next((r for part, r in PLAUSIBLE.items() if part in name.lower()), None)
