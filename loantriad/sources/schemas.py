"""Schemas of the loan tables.

The two CSV layouts are positional: the order below decides, the header is ignored.
"""

from __future__ import annotations

# Column names and types of the 151-column marketplace loan files, in file order.
MARKETPLACE_COLUMNS = """
id bigint, member_id int, loan_amnt decimal(38,2), funded_amnt decimal(38,2), funded_amnt_inv decimal(38,2),
term string, int_rate decimal(38,2), installment decimal(38,2), grade string, sub_grade string, emp_title
string, emp_length string, home_ownership string, annual_inc decimal(38,2), verification_status string, issued
date, loan_status string, pymnt_plan char, url string, descc string, purpose string, title string, zip_code
string, addr_state string, dti decimal(38,2), delinq_2yrs int, earliest_cr_line date, fico_range_low int,
fico_range_high int, inq_last_6mths int, mths_since_last_delinq int, mths_since_last_record int, open_acc int,
pub_rec int, revol_bal decimal(38,2), revol_util decimal(38,2), total_acc int, initial_list_status char,
out_prncp decimal(38,2), out_prncp_inv decimal(38,2), total_pymnt decimal(38,2), total_pymnt_inv decimal(38,2),
total_rec_prncp decimal(38,2), total_rec_int decimal(38,2), total_rec_late_fee decimal(38,2), recoveries
decimal(38,2), collection_recovery_fee decimal(38,2), last_pymnt_d date, last_pymnt_amnt decimal(38,2),
next_pymnt_d date, last_credit_pull_d date, last_fico_range_high int, last_fico_range_low int,
collections_12_mths_ex_med int, mths_since_last_major_derog int, policy_code int, application_type string,
annual_inc_joint decimal(38,2), dti_joint decimal(38,2), verification_status_joint string, acc_now_delinq int,
tot_coll_amt decimal(38,2), tot_cur_bal decimal(38,2), open_acc_6m int, open_act_il int, open_il_12m int,
open_il_24m int, mths_since_rcnt_il int, total_bal_il decimal(38,2), il_util decimal(38,2), open_rv_12m int,
open_rv_24m int, max_bal_bc decimal(38,2), all_util decimal(38,2), total_rev_hi_lim decimal(38,2), inq_fi int,
total_cu_tl int, inq_last_12m int, acc_open_past_24mths int, avg_cur_bal decimal(38,2), bc_open_to_buy
decimal(38,2), bc_util decimal(38,2), chargeoff_within_12_mths int, delinq_amnt decimal(38,2),
mo_sin_old_il_acct int, mo_sin_old_rev_tl_op int, mo_sin_rcnt_rev_tl_op int, mo_sin_rcnt_tl int, mort_acc int,
mths_since_recent_bc int, mths_since_recent_bc_dlq int, mths_since_recent_inq int,
mths_since_recent_revol_delinq int, num_accts_ever_120_pd int, num_actv_bc_tl int, num_actv_rev_tl int,
num_bc_sats int, num_bc_tl int, num_il_tl int, num_op_rev_tl int, num_rev_accts int, num_rev_tl_bal_gt_0 int,
num_sats int, num_tl_120dpd_2m int, num_tl_30dpd int, num_tl_90g_dpd_24m int, num_tl_op_past_12m int,
pct_tl_nvr_dlq decimal(38,2), percent_bc_gt_75 decimal(38,2), pub_rec_bank_ruptcies int, tax_liens int,
tot_hi_cred_lim decimal(38,2), total_bal_ex_mort decimal(38,2), total_bc_limit decimal(38,2),
total_il_high_credit_limit decimal(38,2), revol_bal_joint decimal(38,2), sec_app_fico_range_low int,
sec_app_fico_range_high int, sec_app_earliest_cr_line date, sec_app_inq_last_6mths int, sec_app_mort_acc int,
sec_app_open_acc int, sec_app_revol_util decimal(38,2), sec_app_open_act_il int, sec_app_num_rev_accts int,
sec_app_chargeoff_within_12_mths int, sec_app_collections_12_mths_ex_med int,
sec_app_mths_since_last_major_derog int, hardship_flag char, hardship_type string, hardship_reason string,
hardship_status string, deferral_term int, hardship_amount decimal(38,2), hardship_start_date date,
hardship_end_date date, payment_plan_start_date date, hardship_length int, hardship_dpd int,
hardship_loan_status string, orig_projected_additional_accrued_interest decimal(38,2),
hardship_payoff_balance_amount decimal(38,2), hardship_last_payment_amount decimal(38,2), disbursement_method
string, debt_settlement_flag char, debt_settlement_flag_date date, settlement_status string, settlement_date
date, settlement_amount decimal(38,2), settlement_percentage decimal(38,2), settlement_term int
"""

# Column names and types of the 51-column bank loan files, in file order.
BANK_COLUMNS = """
insert_sysdate timestamp, branch_code int, branchname string, loan_file_numberr bigint, client_id int, sit_flag
char, interest_rate decimal(19,2), total_repayment_up_to_now decimal(28,8), commission_amount_remain
decimal(28,8), charge decimal(28,8), discount decimal(28,8), advance_pay_to_total_cash decimal(28,8),
advance_pay_to_remain_non_cash decimal(28,8), is_installment char, interest_sum decimal(28,8),
installment_number_remain int, receivable_installment_number int, first_passed date, total_payment_up_to_now
decimal(28,8), finalized_loan_amount decimal(28,8), penalty decimal(28,8), first_payment_date_in_du date,
principal_sum decimal(28,8), advance_pay decimal(28,8), sit_duration int, sit_duration_day int,
sit_distribute_phases int, sit_fast_receive_percent float, frequency int, customer_obligation_amount
decimal(28,8), customer_share_cash_amount decimal(28,8), customer_share_non_cash_amount decimal(28,8),
bank_share_cash_amount decimal(28,8), bank_share_non_cash_amount decimal(28,8), first_overdue date,
loan_duration_day int, loan_file_number bigint, createdate date, long_title string, status string, contract
string, approval_amount decimal(28,8), title string, inc_commission_amount decimal(28,8), interest_amount
decimal(28,8), obligation_penalty decimal(28,8), passed_date date, penalty_interest decimal(28,8), to_due_date
decimal(28,8), to_end_of_month decimal(28,8), due_date date
"""

# The application loan table, key (LOAN_FILE_NUMBER, CUSTOMER_ID).
APPLICATION_SCHEMA = (
    "CUSTOMER_ID bigint, LOAN_FILE_NUMBER bigint, LOAN_AMOUNT decimal(20,2), COLLATERAL_NEEDED_VALUE decimal(20,2), "
    "MONTHLY_INCOME decimal(20,2), CURRENT_LOAN_RATES decimal(5,2), LOAN_PURPOSE string, LOAN_SUBJECT string, "
    "FILE_STATUS_TITLE2 string, LOAN_DATE timestamp_ntz, APPLICATION_TYPE int, LOAN_DURATION_DAY int, "
    "LOAN_DURATION_MONTH int, LOAN_DURATION_YEAR int, CITY_CODE int, PROVINCE_ID int, CONTRACT_TYPE_ID int, "
    "IS_INSTALLMENT int, INSTALLMENT_NUMBER int, COMPANY_TYPE int, GENDER int, BIRTH_PLACE int, EDUCATION_GRADE int, "
    "OCCUPATION int, MARITAL_STATUS int, BRANCH_CODE int"
)

FEATURE_METADATA_SCHEMA = (
    "feature_id int, column_name string, table_name string, importance_level smallint, importance_description string"
)


def layout(text: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a column list; a comma inside ``decimal(p,s)`` has no space after it."""
    return [tuple(item.split(" ", 1)) for item in " ".join(text.split()).split(", ")]


MARKETPLACE = layout(MARKETPLACE_COLUMNS)
BANK = layout(BANK_COLUMNS)
