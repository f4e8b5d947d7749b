"""Ready-made run specs: the standard four-pass ledger-credit vs
statement-debit configuration and the variants used by the registered
queries."""

from __future__ import annotations

from matchbook.spec import Aggregation, Attribute, Filter, MatchPass, RunSpec

# Fixed values of the standard configuration.
SET_ID = "USD_NOSTRO_CITIBANK"
CYCLE_DATE = "2024-01-15"
GL_CR = (Filter("LS_TYPE", "=", "GL"), Filter("DR_CR_IND", "=", "CR"),
         Filter("STATUS", "=", "OPEN"))
STMT_DR = (Filter("LS_TYPE", "=", "STMT"), Filter("DR_CR_IND", "=", "DR"),
           Filter("STATUS", "=", "OPEN"))


def o2o_pass(**kw) -> MatchPass:
    base = dict(id="MP_O2O", name="Single credits, same reference",
                match_type="ONE_TO_ONE", left=GL_CR, right=STMT_DR,
                quality=90, rule_order=1, attributes=(
                    Attribute("AMOUNT", "AMOUNT", "EQUALS", mandatory=True),
                    Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
                    Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=True,
                              tolerance_days=1),
                    Attribute("REFERENCE", "REFERENCE", "EQUALS", mandatory=False)))
    base.update(kw)
    return MatchPass(**base)


def o2m_pass(**kw) -> MatchPass:
    base = dict(id="MP_O2M", name="Credits paid in parts",
                match_type="ONE_TO_MANY", left=GL_CR, right=STMT_DR,
                quality=85, rule_order=2, attributes=(
                    Attribute("AMOUNT", "AMOUNT", "EQUALS", mandatory=True,
                              aggregation=Aggregation("RIGHT", "SUM")),
                    Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
                    Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=True,
                              tolerance_days=2)))
    base.update(kw)
    return MatchPass(**base)


def m2o_pass(**kw) -> MatchPass:
    base = dict(id="MP_M2O", name="Credits paid together",
                match_type="MANY_TO_ONE", left=GL_CR, right=STMT_DR,
                quality=85, rule_order=3, attributes=(
                    Attribute("AMOUNT", "AMOUNT", "EQUALS", mandatory=True,
                              aggregation=Aggregation("LEFT", "SUM")),
                    Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
                    Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=True,
                              tolerance_days=2)))
    base.update(kw)
    return MatchPass(**base)


def m2m_pass(**kw) -> MatchPass:
    base = dict(id="MP_M2M", name="Credit batches against debit batches",
                match_type="MANY_TO_MANY", left=GL_CR, right=STMT_DR,
                quality=80, rule_order=4, attributes=(
                    Attribute("AMOUNT", "AMOUNT", "WITHIN", mandatory=True,
                              tolerance_amount=0.01),
                    Attribute("CURRENCY", "CURRENCY", "EQUALS", mandatory=True),
                    Attribute("VALUE_DATE", "VALUE_DATE", "WITHIN", mandatory=True,
                              tolerance_days=3)))
    base.update(kw)
    return MatchPass(**base)


def standard_spec(**kw) -> RunSpec:
    base = dict(set_id=SET_ID, cycle_date=CYCLE_DATE,
                passes=(o2o_pass(), o2m_pass(), m2o_pass(), m2m_pass()))
    base.update(kw)
    return RunSpec(**base)
