"""Physical constants, thresholds and result cut points."""

# Fixed values (signal physics and receiver limits)
LIGHT_SPEED_M_S = 299792458.0
L1_HZ = 1575.42e6
L1_WAVELENGTH_M = LIGHT_SPEED_M_S / L1_HZ
EARTH_RADIUS_KM = 6371.0088
METRES_PER_DEGREE = 111320.0
CN0_RANGE = (0.0, 60.0)
WEAK_CN0 = 30.0
RESIDUAL_MAX_GAP_S = 1.0
CODE_RESIDUAL_MAX = 5000.0
CARRIER_RESIDUAL_MAX = 1.0e4
CMC_STEP_MAX = 1.0e5
CARRIER_SANITY_HZ = 5.0
ARC_GAP_S = 0.35
ARC_SLIP_CYCLES = 5.0
TRAILING_ROWS = 20
SLOPE_HIGH = 3.0
LOCAL_OFFSET_HOURS = 2
REFERENCE_FIX_S = 60

# Fixed values (alerts, correlation, incidents)
ENTER_STREAK = 3
EXIT_STREAK = 5
WINDOW_S = 120
DECAY_KM = 2.0
INCIDENT_KM = 5.0
THRESHOLD = 0.52

# Fixed values (profile and drift)
BOUND_MARGIN = 0.25
PSI_BINS = 10
PSI_FLOOR = 1e-6
PSI_MINOR = 0.10
PSI_MAJOR = 0.25
PSI_MIN_ROWS = 100
NON_NEGATIVE = (
    "hAcc", "vAcc", "sAcc", "headAcc", "pDOP", "numSV", "pos_dev_m",
    "n_sats_l1", "snr_l1_mean", "snr_l1_std", "snr_l1_min",
    "doppler_l1_std", "pr_doppler_residual_std",
    "jam_ind_mean", "agc_cnt_mean", "noise_per_ms_mean",
)

# Fixed values (spatial statistics)
NEIGHBOURS = 5
MIN_SITES = 15
PERMUTATIONS = 999
ALPHA = 0.05

# Fixed values (request limits)
BATCH_MAX = 500
NOTE_MAX = 2000
ANALYST_MAX = 120
